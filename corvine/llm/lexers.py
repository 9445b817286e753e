"""Tokens of the five languages: one pass of one regular expression, then bracket groups."""

from __future__ import annotations

import re

import regex

from corvine.llm.gll import Groups

_WS = r"[ \t\f\v ﻿\r]+"
_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:(?:[1-9][0-9_]*|0)(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)"
_NAME = r"[^\W\d][\w]*"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"', r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_TPL = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|\{[^{}`]*\})*\})*`"

_SKIP = rf"(?:\s+|{_COMMENT})*"
JAVA = re.compile(rf'{_SKIP}("""[ \t\f\r]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|{_DQ}|\'(?:[^\'\\\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)\'|{_NUM}[lLfFdD]?(?![\w$])|0[0-7_]+[lL]?(?![\w$])|(?:[^\W\d]|\$)[\w$]*|->|::|\.\.\.|\+\+|--|&&|\|\||[=!<+\-*/&|^%]=|<<=|<<|@|[()\[\]{{}};,.=<>!~?:+\-*/&|^%]|\S)')
JS = re.compile(rf"(?:{_WS})?(?://[^\n]*)?(/\*[\s\S]*?\*/|\n|{_DQ}|{_SQ}|{_TPL}|(?:(?<=[=(,:;!&|?{{}}\[+\-*%<>~^\n])|(?<=return)|(?<=typeof)|(?<=[=(,:;!&|?{{}}\[+\-*%<>~^\n] )|(?<=return )|(?<=\n    )|(?<=\n        )|(?<=^)){_REGEX}|{_NUM}n?(?![\w$])|#?(?:[^\W\d]|\$)[\w$]*|>>>=|>>=|\.\.\.|=>|\?\.(?!\d)|\?\?=|\?\?|\*\*=|\*\*|&&=|\|\|=|&&|\|\||===|!==|==|!=|<<=|<<|<=|>=|\+\+|--|[+\-*/%&|^]=|[()\[\]{{}};,.=<>!~?:+\-*/&|^%@]|\S)")
GO = re.compile(rf"[ \t\r]*(?://[^\n]*)?(/\*[\s\S]*?\*/|\n|`[^`]*`|{_DQ}|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[0-7]{{3}}|[abfnrtv\\'\"]))'|{_NUM}i?(?![\w])|0[0-7_]+i?(?![\w])|{_NAME}|\.\.\.|:=|<-|\+\+|--|&&|\|\||&\^=|&\^|<<=|>>=|<<|>>|[=!<>+\-*/&|^%]=|[()\[\]{{}};,.=<>!:+\-*/&|^%~]|\S)")
_PS = r"(?:[rRbBuU]|[rR][bB]|[bB][rR]|[fF]|[rR][fF]|[fF][rR])?"
PY = re.compile(rf"(?:[ \t\f]|\\\n)*(?:#[^\n]*)?(\n[ \t\f]*|{_PS}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:(?:[1-9][0-9_]*|0[0_]*(?![0-9]))(?:\.[0-9_]*)?|[0-9][0-9_]*\.[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[jJ]?)(?![\w])|{_NAME}|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|[=!<>+\-*/%&|^@]=|[()\[\]{{}};,.=<>~:+\-*/%&|^@]|\S)")

#: Reserved words of each language (kinds of their own), and words reserved only in some places.
WORDS = {
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record var yield sealed permits when".split(),
    "js": "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let static async await yield of get set as from type interface namespace module declare abstract public private protected readonly implements override keyof infer is asserts unique satisfies".split(),
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split(),
    "py": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type True False None".split(),
}
#: Fixed value: Python itself takes no brackets nested deeper.
PYTHON_DEEPEST = 200
_CLOSE = {")": "(", "]": "[", "}": "{"}
_OPENERS = frozenset("([{")
_ERR = "ERR"


_BAD_ESCAPE = re.compile(r"(?:[^\\]|\\[^xuUN])*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^{}]+\}))")
_BAD_BYTE = re.compile(r"(?:[^\\]|\\[^x])*\\x(?![0-9a-fA-F]{2})")


def _text_kind(t: str) -> str:
    """STR or BYTES of a Python literal with or without a prefix; an error for broken escapes and for bytes beyond ASCII."""
    prefix = t[: re.match("[A-Za-z]*", t).end()].lower()
    if "f" in prefix:
        return "FSTR"
    if "b" in prefix:
        return _ERR if not t.isascii() or "r" not in prefix and "\\" in t and _BAD_BYTE.match(t) else "BYTES"
    return _ERR if "r" not in prefix and "\\" in t and _BAD_ESCAPE.match(t) else "STR"


class _Kinds(dict):
    """Token text to kind; strings, numbers and names by their first characters. Only short texts are remembered."""

    def __init__(self, language: str) -> None:
        super().__init__({w: w for w in WORDS[language]})
        self.language = language

    def __missing__(self, t: str) -> str:
        c = t[0]
        if c == "\n" or (t[:2] == "/*" and len(t) > 3):
            k = "\n" if "\n" in t else "SKIP"
        elif c.isalpha() or c in "_$" or ord(c) > 127:
            if t[-1] in "\"'" and len(t) > 1 and self.language == "py":
                k = _text_kind(t)
            elif t.isidentifier() or (self.language in ("js", "java") and t.replace("$", "a").isidentifier()):
                k = "NAME"
            else:
                k = _ERR
        elif c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            k = _ERR if "__" in t or t.endswith("_") or (t.isdigit() and len(t) > 1 and c == "0" and self.language not in ("java", "go") and t.strip("0")) or (len(t) == 1 and not c.isascii()) else "NUM"
        elif c in "\"'`":
            k = ("TPL" if c == "`" and self.language == "js" else "STR") if len(t) > 1 and t[-1] == c else _ERR
            if k == "STR" and "\\" in t and self.language == "py":
                k = _text_kind(t)
        elif self.language == "js" and (t.lstrip(" \t")[:1] == "/" and len(t.strip()) > 2):
            k = "REGEX"
        elif self.language == "js" and c == "#" and len(t) > 1:
            k = "PRIV"
        elif c in "()[]{};,.=<>!~?:+-*/&|^%@":
            k = t
        else:
            k = _ERR
        if self.language == "py" and t in ("!", "?", "$"):
            k = _ERR
        if len(t) <= 24 and len(self) < 200_000:
            self[t] = k
        return k


_KINDS = {k: _Kinds(k) for k in WORDS}
_TEMPLATE = regex.compile(r"(?P<t>`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?P<e>(?:[^{}`'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|(?P>t)|\{(?P>e)\})*)\})*`)")
_SIMPLE_FIELD = re.compile(r"\s*[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*\Z")


_BRACKETS = frozenset("()[]{}")
_LINES_TOO = frozenset("()[]{}\n")


def group(kinds: list, groups: Groups) -> tuple | None:
    """Nest bracket groups; None when brackets don't match."""
    stack: list = []
    out: list = []
    at = 0
    for i in [i for i, k in enumerate(kinds) if k in _BRACKETS]:
        out += kinds[at:i]
        at = i + 1
        k = kinds[i]
        if k in _OPENERS:
            stack.append((k, out))
            out = []
        else:
            if not stack:
                return None
            opener, outer = stack.pop()
            if opener != _CLOSE[k]:
                return None
            outer.append(groups.intern(opener, tuple(out)))
            out = outer
    return None if stack else (*out, *kinds[at:])


def _kinds_of(language: str, toks: list) -> list | None:
    kinds = list(map(_KINDS[language].__getitem__, toks))
    if _ERR in kinds:
        return None
    return [k for k in kinds if k != "SKIP"] if "SKIP" in kinds else kinds


_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp".split())


def java(code: str, groups: Groups) -> tuple | None:
    toks = JAVA.findall(code.rstrip("\x1a") + "\n\x00")  # an end mark, so that the last comment is skipped whole
    if toks.pop() != "\x00":
        return None
    kinds = _kinds_of("java", toks)
    if kinds is None:
        return None
    run: set = set()
    last = -2
    for i in [i for i, k in enumerate(kinds) if k in _MODIFIERS]:  # none twice in a row of them
        run = run if i == last + 1 else set()
        if kinds[i] in run:
            return None
        run.add(kinds[i])
        last = i
    return group(kinds, groups)


_GO_END = frozenset("NAME NUM STR break continue fallthrough return ++ -- ) ] }".split())


def go(code: str, groups: Groups) -> tuple | None:
    """A line end behind the end of an operand is a semicolon."""
    kinds = _kinds_of("go", GO.findall((code[1:] if code[:1] == "\ufeff" else code) + "\n"))
    if kinds is None:
        return None
    out: list = []
    at = 0
    for i in [i for i, k in enumerate(kinds) if k == "\n"]:
        if i > at:
            out += kinds[at:i]
        if out and out[-1] in _GO_END:
            out.append(";")
        at = i + 1
    return group(out, groups)


_JS_OPEN = frozenset("; , . ?. = + - * / % & | ^ < ? : == === != !== && || ?? => ! ~ ... ( [ { typeof void delete new in of instanceof += -= *= /= %= ??= &&= ||= ** **= <= >= << <<= >>= >>>= &= |= ^= extends case else do import const let var function @ as implements".split())
_JS_CONT = frozenset("; , . ?. = + - * / % & | ^ < > ? : == === != !== && || ?? => += -= *= /= %= ??= &&= ||= ** **= <= >= << <<= >>= >>>= &= |= ^= ) ] } in instanceof ( [ extends implements satisfies TPL".split())


_JS_WS = re.compile(rf"(?:{_WS}|//[^\n]*)*")
_JS_REGEX = re.compile(_REGEX)
_JS_HEADS = frozenset("if while for with".split())
_JS_VALUE_ENDS = re.compile(r"[\w$)\]\"'`]\Z")
_JS_NOT_VALUES = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends".split())


def _js_tokens(code: str, at: int = 0, inner: bool = False, fields: list | None = None) -> tuple[list, int]:
    """(tokens one by one, where they end): a slash begins a regular expression where no value stands before it, and behind the
    head of an if, while, for or with; the tokens of a template's fields are added to ``fields``. With ``inner`` up to the
    brace that closes a field. Used where the fast pass finds no parse, as it goes by the characters before a slash alone."""
    out: list = []
    heads: list = []
    prev, before, closes, depth, n = "", "", False, 0, len(code)
    while (at := _JS_WS.match(code, at).end()) < n:
        if code[at] == "`":
            at = _template_end(code, at, fields if fields is not None else [])
            if at < 0:
                break
            t = "``"
        else:
            m = None
            if code[at] == "/" and code[at + 1 : at + 2] not in ("/", "*") and (closes or not _JS_VALUE_ENDS.search(prev) or prev in _JS_NOT_VALUES):
                m = _JS_REGEX.match(code, at)
                t = m.group() if m else ""
            if m is None:
                m = JS.match(code, at)
                if m is None:
                    break
                t = m.group(1)
            at = m.end()
            if inner and t == "}" and not depth:
                return out, at
            depth += (t == "{") - (t == "}")
        out.append(t)
        closes = False
        if t == "\n" or t[:2] == "/*":
            continue
        if t == "(":
            heads.append(prev in _JS_HEADS and before != "." or prev == "await" and before == "for")
        elif t == ")" and heads:
            closes = heads.pop()
        prev, before = t, prev
    else:
        if not inner:
            return out, n
    return ["\\"], n


_TEMPLATE_SIGN = re.compile(r"\\[\s\S]|`|\$\{")


def _template_end(code: str, at: int, fields: list) -> int:
    """Where the template that begins at an offset ends, -1 for nowhere."""
    at += 1
    while (m := _TEMPLATE_SIGN.search(code, at)) is not None:
        at = m.end()
        if m.group() == "`":
            return at
        if m.group() == "${":
            toks, at = _js_tokens(code, at, True, fields)
            fields.append(toks)
    return -1


def js(code: str, groups: Groups, grammar=None, exact: bool = False) -> tuple | None:
    """Line ends stay as NL only where a statement may end: neither behind a token that wants more nor before one that goes on."""
    if code[:2] == "#!":
        code = code[code.find("\n") :] if "\n" in code else ""
    code += "\n"
    if exact:
        fields: list = []
        toks, _ = _js_tokens(code, fields=fields)
        for f in fields:
            content = _js_lines(f, groups, grammar)
            if content is None or (grammar is not None and not grammar.derives("Expr", content, groups)):
                return None
        return _js_lines(toks, groups, grammar)
    toks = JS.findall(code)
    if "`" in toks:  # nested templates: take them out one by one
        if code.count("`") % 2 == 0:
            code = _TEMPLATE.sub(lambda m: "``" if _fields_ok(m.group(0), groups, grammar) else "`", code)
            toks = JS.findall(code)
        if "`" in toks:
            return None
    for t in toks:
        if t[0] == "`" and "${" in t and not _fields_ok(t, groups, grammar):
            return None
    return _js_lines(toks, groups, grammar)


def _js_lines(toks: list, groups: Groups, grammar) -> tuple | None:
    kinds = _kinds_of("js", toks)
    if kinds is None:
        return None
    out: list = []
    at, prev = 0, ";"
    script = grammar is not None and "TypeArgs" not in grammar.rules  # without types, > at a line's end wants more
    ends = [i for i, k in enumerate(kinds) if k == "\n"]
    ends.append(len(kinds))
    for i in ends:
        if i > at:
            k = kinds[at]
            if at and prev not in _JS_OPEN and not (script and prev == ">") and k not in _JS_CONT and not (k == "{" and prev != "}"):
                out.append("NL")
            out += kinds[at:i]
            prev = out[-1]
        at = i + 1
    return group(out, groups)


def _fields_ok(template: str, groups: Groups, grammar) -> bool:
    """Every ${...} of a template holds an expression."""
    i = 0
    while (i := template.find("${", i)) >= 0:
        if len(template) > i and template[i - 1] == "\\" and template[i - 2] != "\\":
            i += 2
            continue
        depth, j = 1, i + 2
        while j < len(template) and depth:
            depth += {"{": 1, "}": -1}.get(template[j], 0)
            j += 1
        field = template[i + 2 : j - 1]
        if not _SIMPLE_FIELD.match(field):
            content = js(field, groups, grammar, "/" in field)
            if content is None or (grammar is not None and not grammar.derives("Expr", content, groups)):
                return False
        i = j
    return True


_WIDTHS: dict[str, int] = {}


def _width(line_end: str) -> int:
    if line_end not in _WIDTHS:
        width = 0
        for ch in line_end[1:]:
            width = (width // 8 + 1) * 8 if ch == "\t" else 0 if ch == "\f" else width + 1
        _WIDTHS[line_end] = width
    return _WIDTHS[line_end]


def python(code: str, groups: Groups, grammar) -> list | None:
    """Logical lines as (indentation, tokens with nested groups); None when brackets can't be right."""
    if code[:1] == "\ufeff":
        code = code[1:]
    if "\r" in code:
        code = code.replace("\r\n", "\n").replace("\r", "\n")
    if "\x00" in code:
        return None
    toks = PY.findall("\n" + code + "\n")
    kinds = list(map(_KINDS["py"].__getitem__, toks))
    if "FSTR" in kinds:
        for t in {t for t, k in zip(toks, kinds, strict=True) if k == "FSTR"}:
            if ("{" in t or "}" in t or "\\" in t) and not _format_ok(t, groups, grammar):
                break
        else:
            kinds = ["STR" if k == "FSTR" else k for k in kinds]
        if "FSTR" in kinds:  # a wrong one, or one with its own quotes inside: found whole, the slow way
            code = _PY_TEXTS.sub(lambda m: m.group() if m.group("f") is None else '""' if _format_ok(m.group("f"), groups, grammar) else "?", code)
            toks = PY.findall("\n" + code + "\n")
            kinds = list(map(_KINDS["py"].__getitem__, toks))
    if _ERR in kinds or "FSTR" in kinds:
        return None
    lines: list = []
    out: list = []
    stack: list = []
    at = indent = 0
    for i in [i for i, k in enumerate(kinds) if k in _LINES_TOO]:
        if i > at:
            out += kinds[at:i]
        at = i + 1
        k = kinds[i]
        if k == "\n":
            if not stack:
                if out:
                    lines.append((indent, tuple(out)))
                    out = []
                indent = _width(toks[i])
        elif k in _OPENERS:
            if len(stack) == PYTHON_DEEPEST:
                return None
            stack.append((k, out))
            out = []
        else:
            if not stack:
                return None
            opener, outer = stack.pop()
            if opener != _CLOSE[k]:
                return None
            outer.append(groups.intern(opener, tuple(out)))
            out = outer
    return None if stack or out else lines


#: Comments and texts of Python; formatted texts with their fields, in which any quotes may stand again.
_PY_TEXTS = regex.compile(
    r"""#[^\n]*|(?<![\w])(?P<f>(?:[rR][fF]|[fF][rR]?)(?:\"{3}(?:[^"\\{]|\\[\s\S]|"(?!"")|(?P<x>\{\{|\{(?P<e>(?:[^{}"'#]|\#[^\n]*\n|(?P>f)|(?P<s>[rRbBuU]{0,2}(?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*'{3}|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'))|\{(?P>e)\})*)\}))*\"{3}|'{3}(?:[^'\\{]|\\[\s\S]|'(?!'')|(?P>x))*'{3}|"(?!"")(?:[^"\\\n{]|\\[\s\S]|(?P>x))*"|'(?!'')(?:[^'\\\n{]|\\[\s\S]|(?P>x))*'|""(?!")|''(?!')))|(?P>s)"""
)
_PLAIN_FIELD = re.compile(r"\s*[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\s*(?:![rsa])?(?::[^{}]*)?\Z")


def _format_ok(t: str, groups: Groups, grammar) -> bool:
    """Whether every field of a formatted text holds an expression, and its escapes are right."""
    q = re.match("[A-Za-z]*(\"\"\"|\'\'\'|\"|\')", t)
    if "r" not in q.group().lower() and "\\" in t and _BAD_ESCAPE.match(t):
        return False
    return _fields_of(t[q.end() : -len(q.group(1))], groups, grammar, True)


def _fields_of(body: str, groups: Groups, grammar, doubled: bool) -> bool:
    i = 0
    while (i := min((k for k in (body.find("{", i), body.find("}", i)) if k >= 0), default=-1)) >= 0:
        if doubled and body[i : i + 2] in ("{{", "}}"):
            i += 2
        elif body[i] == "{":
            depth, j, cut = 0, i + 1, -1  # the field's end, and where its conversion or format begins
            while j < len(body) and (depth or body[j] != "}"):
                if body[j] in "\"'#" and cut < 0:
                    m = _PY_TEXTS.match(body, j)
                    j = m.end() if m else j + 1
                    continue
                depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(body[j], 0) if cut < 0 else {"{": 1, "}": -1}.get(body[j], 0)
                if not depth and cut < 0 and (body[j] == ":" or body[j] == "!" and body[j + 1 : j + 2] != "="):
                    cut = j
                j += 1
            if j >= len(body):
                return False
            if not _PLAIN_FIELD.match(body, i + 1, j):
                what = body[i + 1 : cut if cut >= 0 else j].strip()
                if re.search(r"[^=!<>]=\Z", what):  # self-documenting
                    what = what[:-1]
                lines = python(f"({what}\n)", groups, grammar) if what else None
                if lines is None or len(lines) != 1 or len(lines[0][1]) != 1 or not grammar.derives("Field", groups.of[lines[0][1][0]][1], groups):
                    return False
                if cut >= 0 and body[cut] == "!":
                    m = re.compile(r"\s*[rsa]\s*(?=[:}])").match(body, cut + 1)
                    if m is None:
                        return False
                    cut = m.end()
                if cut >= 0 and body[cut] == ":" and not _fields_of(body[cut + 1 : j], groups, grammar, False):
                    return False
            i = j + 1
        else:
            return False
    return True
