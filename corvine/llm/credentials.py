"""Credentials in source code and configuration files: found with their offsets, and redacted in place."""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.common import spread
from corvine.llm.syntax import LANGUAGES, extension

MASK = "REDACTED"
#: Parts of names whose values let someone in, in several languages.
SENSITIVE = re.compile(
    r"passw(?:or)?d|passwd|passphrase|pass(?:code|key)?\d*$|pass[_.-]|pwd|(?:^|[_.-])pw(?:$|[_.-]|\d*$)|[a-z]Pw$|secret|token|credential|cred$|creds|apikey|api[_.-]?key|(?:^|[_.-])key\d*$|[a-z0-9]Key\d*$|key[_.-]?(?:text|pem|data|material)$|auth|bearer|jwt|kennwort|passwort|geheim|schluessel|schlüssel|mot[_.-]?de[_.-]?passe|motdepasse|contrase[nñ]a|clave|senha|chave|segredo|wachtwoord|sleutel|parola[_.-]?|chiave|segreto|dsn|x-auth|signature[_.-]?key|salt$|pin$",
    re.I,
)
#: Last words of names that only speak of a secret.
HARMLESS = re.compile(
    r"(?:label|header|name|names|field|fields|pattern|regex|regexp|format|prefix|suffix|length|len|min|max|policy|hint|prompt|title|type|kind|hash|digest|checksum|sha\d*|md5|etag|fingerprint|path|file|dir|folder|ttl|expiry|expires|timeout|count|size|limit|index|column|message|msg|help|placeholder|tokens|tokenizer|keyboard|keyword|keywords|id|ids|arn|ref|url|uri|endpoint|host|mode|cert|certificate|public[_.-]?key|publickey|author|authors|version|url[_.-]?path|alphabet|charset|chars|text)\d*$",
    re.I,
)
#: Shapes that are credentials under any name.
KNOWN = re.compile(
    r"(?<![\w])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[\w-]{30,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{16,}|(?:[a-z]{1,4}k|rk|pk)_(?:live|test|prod)_[A-Za-z0-9]{12,}|msh\.[\w-]{12,}\.[\w-]{12,}|[a-z]{2,5}-[0-9a-f]{32,64}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{6,}\.[\w-]{8,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{40,}|ya29\.[\w-]{20,}|sk-(?:proj|ant|svcacct|admin)-[\w-]{16,}|pypi-[\w-]{30,}|xapp-[\w-]{16,}|dckr_pat_[\w-]{20,}|shp(?:at|ca|pa|ss)_[0-9a-f]{32}|AGE-SECRET-KEY-1[0-9A-Z]{30,}|(?<=hooks\.slack\.com/services/)T\w+/B\w+/\w{12,}|(?<=AccountKey=)[A-Za-z0-9+/=]{24,})(?![\w])"
)
_GLUE = re.compile(r"\\n|\n[ \t]*|")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM = re.compile(r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)((?:(?!-----END|-----BEGIN)[\s\S]){8,}?)(?=-----END|[\"'`]|\Z)")
_MARK = re.compile(r"-----(?:BEGIN|END [A-Z0-9 ]*-----|END)")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]{1,20}://([^\s/:@\"'`<>]*):([^\s/@\"'`]+)@[\w\[${]")
_QUERY = re.compile(r"[?&;](?:password|passwd|pwd|pass|token|access_token|api_?key|secret|sig|signature|auth)=([^&\s\"'`<>#;]+)", re.I)
_SCHEME = re.compile(r"^\s*(basic|bearer|token|digest|apikey)\s+(\S+)\s*$", re.I)
_PLACEHOLDER = re.compile(
    r"""^(?:[x*.•\-_?#0]+|<[^>]*>|\$\{[^}]*\}|\$\([^)]*\)|\$\w+|%\w*%|\{\{.*\}\}|\{\w*\}|\[[\w\s.-]*\]|__\w+__|@\w+@
    |(?:change|replace|fill|insert|put|enter|set|add|ask|see|use)[-_ ]?(?:me|this|it|in|here|your|the|with)\b.*|your[-_ ]?.*|my[-_ ]?(?:secret|password|token|key)|(?:the|a|an|some|any)(?:[-_ ][a-z]+)+|(?:example|dummy|sample|fake|mock|placeholder)[-_ ]?(?:[a-z]+[-_ ]?)*\d{0,4}|redacted|removed|hidden|masked|secret|password|passwd|token|changeit|default|none|null|nil|undefined|true|false|todo(?:[-_: ][a-z]+)*:?|tbd|fixme|n/a|test|testing|foo|bar|foobar|abc123|to[-_ ]?be[-_ ]?.*|not[-_ ]?(?:set|used|needed|a[-_ ]).*
    |.*-(?:here|goes-here|placeholder)|(?:vault|env|file|ssm|secretsmanager|aws-sm|gcp-sm|sm|op|kms|keyring|k8s|kv|ref|arn|projects|secret|secrets|akv|bao|doppler|consul|sops|enc)[:/].*|(?:/|\./|~/).*|file:.*|.*\.(?:pem|crt|cer|key|txt|json|ya?ml|env|jks|p12))$""",
    re.I | re.X,
)
_PATTERN = re.compile(r"\(\?[=!:<]|\\[dwsb]|\{\d+(?:,\d*)?\}|^\^.*\$$|[)\]][+*]")
_ALPHABET = re.compile(r"abcdefgh|ABCDEFGH|0123456789")
_B64 = re.compile(r"^[A-Za-z0-9+/_-]{12,}={0,2}$")


def _decoded(v: str) -> str | None:
    if not _B64.match(v):
        return None
    try:
        return base64.b64decode(v + "=" * (-len(v) % 4), altchars=b"-_" if set("-_") & set(v) else None, validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None


def _patterned(v: str) -> bool:
    """Whether a value holds parts of a regular expression; a range in brackets is looked for without backtracking."""
    return bool(_PATTERN.search(v)) or any("-" in x[x.find("[") + 1 :] for x in v.split("]")[:-1] if "[" in x)


#: Pieces of a name as people write them: a word, a run of capitals, a single capital.
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
_NO_WORD = re.compile(r"[^aeiouyAEIOUY]+\Z|.*[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{5}|.{1,2}\Z|[A-Z]+\Z")


def _random_letters(v: str) -> bool:
    """Whether letters of both cases are a random mix: a good part of them stands in pieces that are no words."""
    if len(v) < 8 or v.islower() or v.isupper():
        return False
    pieces = _PIECE.findall(v)
    return len(pieces) >= 3 and sum(len(p) for p in pieces if _NO_WORD.match(p)) >= 0.4 * sum(map(len, pieces))


#: Words of sentences and labels, which no passphrase is made of.
_PROSE = frozenset("the a an your my is are must not should be of to in and or for with please enter type here this that password passphrase secret token key from by at it".split())


def passphrase(name: str, v: str) -> bool:
    """Whether a value is a run of small words under the name of a passphrase or of a recovery phrase."""
    words = re.split(r"[ -]", v.strip())
    return len(words) >= 4 and bool(re.search(r"pass(?:word|phrase|wd)?$|pwd$|mnemonic|seed[_.-]?phrase|recovery", name, re.I)) and all(re.fullmatch(r"[a-z]{3,12}", w) for w in words) and not _PROSE & set(words)


def secret_shape(v: str, loose: bool = True) -> bool:
    """Whether a value under a sensitive name is one that lets someone in, and no placeholder, reference, label or pattern."""
    v = v.strip()
    if len(v) < 6 or _PLACEHOLDER.match(v) or re.search(r"\s", v) or len(set(v)) < 4:
        return False
    if v.startswith(("-----BEGIN", "data:", "http://", "https://", "urn:", "sha256:", "sha1:", "md5:", "ssh-rsa ", "ssh-ed25519")) or _ALPHABET.search(v):
        return False
    if re.search(r"\$\{|\{\{|process\.env|os\.environ|getenv", v) or "://" in v:
        return False
    if _patterned(v) and not re.search(r"[!~^?]\w", v[1:]) or re.fullmatch(r"\^.*\$|.*\{\d+,\d*\}.*", v):
        return False
    digit, lower, upper, sign = (re.search(p, v) for p in (r"\d", r"[a-z]", r"[A-Z]", r"[^\w\s.\-/:]"))
    if re.fullmatch(r"[\d.,:_-]+", v):
        return bool(loose and re.fullmatch(r"\d{6,}", v))
    if re.fullmatch(r"[A-Za-z]+(?:[-_./:+][A-Za-z]*)*", v):  # words; only a random mix of letters is none
        return _random_letters(v)
    if re.fullmatch(r"[a-z]+(?:[-_.][a-z]+)*[-_.]?v?\d{1,2}", v) and len(v) < 12 and not re.fullmatch(r"[a-z]{4,}\d{2,}", v):
        return False
    return bool(digit or sign and (lower or upper))


def sensitive(name: str) -> bool:
    return bool(SENSITIVE.search(name)) and not HARMLESS.search(name)


def _inside(v: str) -> list[tuple[int, int]]:
    """Spans of all credentials that a text holds whatever its name, in order and apart: keys, known shapes, addresses with
    a password. A key goes up to its end mark, without one up to the next mark or the end."""
    found = []
    for m in PRIVATE.finditer(v):
        to = _MARK.search(v, m.end())
        end = len(v) if to is None else to.end() if to.group().startswith("-----END") else to.start()
        if MASK not in v[m.end() : end]:
            found.append((m.start(), end))
    found += [m.span() for m in KNOWN.finditer(v)]
    if "://" in v:
        for m in _URL.finditer(v):
            if _user_secret(m.group(2)):
                found.append(m.span(2))
        for m in _QUERY.finditer(v):
            if secret_shape(m.group(1), loose=False):
                found.append(m.span(1))
    if (m := _SCHEME.match(v)) is not None and (d := m.group(2)):
        text = _decoded(d) if m.group(1).lower() == "basic" else None
        if (text and ":" in text and not _PLACEHOLDER.match(text.split(":", 1)[1])) or (m.group(1).lower() != "basic" and secret_shape(d)):
            found.append(m.span(2))
    elif not found and len(v) >= 24 and (text := _decoded(v.strip())) and (PRIVATE.search(text) or ((u := _URL.search(text)) and _user_secret(u.group(2)))):
        found.append((0, len(v)))
    return _apart(found)


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, without those that begin inside an earlier one."""
    out: list = []
    for x in sorted(spans):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _user_secret(p: str) -> bool:
    return len(p) >= 4 and not _PLACEHOLDER.match(p) and not re.search(r"^[<${%*]|\$\{", p) and not re.fullmatch(r"(?:pass|password|pw|pwd|secret|xxx+|\*+)", p, re.I)


_TOKENS = {
    "py": re.compile(r"""#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')"""),
    "c": re.compile(r"""/\*[\s\S]*?\*/|//[^\n]*|\"\"\"[\s\S]*?\"\"\"|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|(?<=[=(,:;!&|?{}\[+\-*%<>~])[ \t]*/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/"""),
}
_WORTH = re.compile(r"[^a-z \n.,'-]")
#: What stands before a value, read backwards from it: operator and name, however long.
_KEYED = regex.compile(r"""(?r)(?:["'`]([\w.$ -]+)["'`]\]?|([A-Za-z_$][\w$.-]*)["'\]]?\??(?:\s*:\s*[A-Za-z_][\w<>\[\], .|]*?)?)\s*(?::=|=>|==?=?|!==?|:|,|\(|\|\||\?\?|\bor\b)\s*(?:[rRbBuUfF]{0,2})\(?\s*""")
_LEAD = re.compile(r"(?:\\\n|\s)*")
_LEFT = re.compile(r"""^[ \t]*(?:(?:export|const|let|var|final|static|private|public|protected|readonly|Object|String|char\[\]|val|self\.|this\.|#define)\s*)*["']?([A-Za-z_$][\w$.-]*)["']?\s*(?::\s*[\w<>\[\], |]+?)?\s*(?::=|=(?!=)|:)""")
_LOGIN = re.compile(r"(?:connect|open|session|login|log_in|signin|sign_in|authenticate|auth|dial|credentials?|client|basicauth|basic_auth)\w*\s*\(\s*(?:[^()]*,\s*)?\Z", re.I)
_NOTE = [
    re.compile(r"(?:^|[\s\"'(,;{])[\w.-]*?(?:passw(?:or)?d|passwd|pwd|pw|pass|passphrase|token|secret|api[_ -]?key|x-api-key|x-auth(?:-token)?|key|kennwort|passwort|contraseña|senha|wachtwoord|mot de passe|authorization)[\w.-]*?\s*(?:[:=]|\bis\b|\bwas\b|\s)\s*[\"'`]?(?:bearer\s+|basic\s+)?([^\s\"'`,;]+)", re.I),
    re.compile(r"\s-p([^\s\"'`-][^\s\"'`]{5,})"),
    re.compile(r"\s(?:-u|--user)\s+[\"']?[\w.@-]+:([^\s\"']+)"),
    re.compile(r"--?(?:password|passwd|token|secret|api-?key)[= ]+[\"']?([^\s\"']+)", re.I),
]


_BREAK = re.compile(r"\n|\\(?:r\\n|[\s\S])")
_PAIR = re.compile(r"""(?:^|(?<=[\s"'(,;{\[#*]))([A-Za-z_][\w.$-]*)["']?\s*(?:=>|:=|[:=])\s*(?:"([^"]+)"|'([^']+)'|([^\s"',;{}]+))""")
_CALL = re.compile(r"[A-Za-z_][\w.]*[(\[]")


def _notes(text: str) -> list[tuple[int, int]]:
    """Spans of the values that prose or a command line names as secret, those of an earlier pattern first."""
    spans: list = []
    for p in _NOTE:
        new = []
        for m in p.finditer(text):
            v = m.group(1).rstrip(".)")
            if secret_shape(v, loose=False) and (re.search(r"\d|[!~^*+?$]", v) or _random_letters(v)) and not re.fullmatch(r"[\d.]+", v) and not _covered(m.start(1), spans):
                new.append((m.start(1), m.start(1) + len(v)))
        spans += new
    return spans


def _covered(at: int, spans: list[tuple[int, int]]) -> bool:
    return any(a <= at < b for a, b in spans)


def _comment(text: str, at: int, out: list) -> None:
    spans = _inside_all(text)
    for a, b in _notes(text):
        if not _covered(a, spans):
            spans.append((a, b))
    if "\n" in text:  # a match over the end of a line may hide one in the next
        start = 0
        for line in text.split("\n"):
            spans += [(start + a, start + b) for a, b in _notes(line) if not _covered(start + a, spans)]
            start += len(line) + 1
    out += [(at + a, at + b, []) for a, b in spans]


def _pieces(v: str) -> Iterator[tuple[int, int]]:
    """Spans of the lines of a text, cut at line feeds and at their escapes in literals."""
    at = 0
    for m in _BREAK.finditer(v):
        if m.group() == "\n" or m.group()[1] in "nr\n":
            yield at, m.start()
            at = m.end()
    yield at, len(v)


def _by_line(v: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of credentials that the lines of a text name, as in embedded configuration; lines with a span taken are left."""
    out: list = []
    for start, end in _pieces(v):
        line = v[start:end]
        if not _WORTH.search(line) or any(a < end and b > start for a, b in taken):
            continue
        judged = []
        for m in _PAIR.finditer(line) if ":" in line or "=" in line else ():
            k = next(k for k in (2, 3, 4) if m.group(k) is not None)
            value, name = m.group(k), m.group(1)
            if k == 4 and name.lower() in ("authorization", "proxy-authorization", "x-authorization"):
                value = line[m.start(4) :].rstrip(" \t\r\"',;")
            inner = _inside(value)
            if inner:
                out += [(start + m.start(k) + x, start + m.start(k) + y) for x, y in inner]
            elif sensitive(name) and secret_shape(value) and not (k == 4 and _CALL.match(value)):
                out.append((start + m.start(k), start + m.start(k) + len(value)))
            else:
                judged += [m.span()] if SENSITIVE.search(name) else []
        out += [(start + a, start + b) for a, b in _notes(line) if not _CALL.match(line, a) and not _covered(a, judged) and not _covered(start + a, out)]
    return out


def _inside_all(v: str) -> list[tuple[int, int]]:
    found = [m.span() for m in KNOWN.finditer(v)]
    found += [m.span(2) for m in _PEM.finditer(v)]
    if "://" in v:
        found += [m.span(2) for m in _URL.finditer(v) if _user_secret(m.group(2))]
    return found


def in_source(ext: str, code: str) -> list[tuple[int, int, list]]:
    """(start, end, further spans) of each credential in source code; further spans are the other parts of a joined value."""
    lang = "py" if ext == "py" else "c"
    out: list = []
    run: list = []  # texts that are joined to one value: (start, end of the content)
    prev_end, run_key, args = -1, 0, []

    def placed(x: int, y: int) -> list[tuple[int, int]]:
        """The spans in the code of a span of the value, one for each part that it touches."""
        got, at = [], 0
        for a, b in run:
            if max(x, at) < min(y, at + b - a):
                got.append((a + max(x, at) - at, a + min(y, at + b - a) - at))
            at += b - a
        return got

    def close() -> None:
        if not run:
            return
        a, b = run[0]
        if len(run) == 1 and b - a < 6:
            return
        value = code[a:b] if len(run) == 1 else "".join(code[a:b] for a, b in run)
        if len(value) < 6 or not _WORTH.search(value) and not 3 <= value.count(" ") + value.count("-") < 24:
            return
        if value.startswith("data:"):
            return
        inner = _inside(value)
        if "\n" in value or "\\n" in value:
            inner = _apart(inner + _by_line(value, inner))
        if inner:
            for x, y in inner:
                first, *more = placed(x, y)
                out.append((*first, more))
            return
        lead = _LEAD.match(value).end()
        whole = placed(lead, len(value.rstrip())) if "\n" in value else list(run)
        value = value[lead:] if "\n" in value else value
        if "\n" in value.strip() or not whole:
            return
        first = code.rfind("\n", 0, run_key) + 1
        if first and not code[first:run_key].strip():  # the key stands on the line before
            first = code.rfind("\n", 0, first - 1) + 1
        m = _KEYED.match(code, first, run_key)
        if m is not None:
            name = m.group(1) or m.group(2)
            harmless = HARMLESS.search(name)
        else:
            name, harmless = "", None
        line = code[code.rfind("\n", 0, run_key) + 1 : run_key]
        if not (name and SENSITIVE.search(name)) and not (name and m.group(1)):
            left = _LEFT.match(line)
            if left and SENSITIVE.search(left.group(1)):
                name, harmless = left.group(1), HARMLESS.search(left.group(1))
        if name and SENSITIVE.search(name) and not harmless and (secret_shape(value) or passphrase(name, value)):
            out.append((*whole[0], whole[1:]))
        elif len(args) >= 2 and _LOGIN.search(line) and secret_shape(value, loose=False) and (re.search(r"[!~^*+?$#%]|\d", value) or _random_letters(value)) and not re.search(r"\.(?:invalid|com|net|org|io|local|internal)\b", value):
            out.append((*whole[0], whole[1:]))

    for t in _TOKENS[lang].finditer(code):
        s = t.group()
        c = s[0]
        if c == "#" and lang == "py" or s[:2] in ("//", "/*"):
            close()
            run = []
            if _WORTH.search(s):
                _comment(s, t.start(), out)
            continue
        if lang == "c" and c not in "\"'`":
            continue
        body = s.lstrip("rRbBuUfF") if lang == "py" else s
        q = 3 if body[:3] in ('"""', "'''") else 1
        a, b = t.end() - len(body) + q, t.end() - q
        gap = code[prev_end : t.start()].strip() if run else None
        if run and (gap in ("+", "\\", "+ \\") or (lang == "py" and not gap and "\n" in code[prev_end : t.start()])):
            run.append((a, b))
        else:
            close()
            args = [*args, run[0]] if gap == "," else []
            run, run_key = [(a, b)], t.start()
        prev_end = t.end()
    close()
    return out


_LINE = re.compile(r"[^\n]*\n?")
_KV = re.compile(r"""^(\s*)(?:export\s+|set\s+|-\s+)?["']?([\w.$\- ]*?[\w\]])["']?\s*(=>|[:=])\s*(.*?)\s*,?\s*\Z""", re.S)


#: Names that say nothing of their value, and names whose value is the name of a sibling's value.
_GENERIC = re.compile(r"(?:default|string|plain|raw)?[_.-]?(?:value|val|default|data|content|contents|text|string|literal|plaintext)$", re.I)
_NAMING = re.compile(r"(?:name|key|variable|var|property|param|parameter|id)$", re.I)
_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?(?:\s+#.*)?")
_FLOW = re.compile(r"""["']?([A-Za-z_][\w.-]*)["']?\s*[:=]\s*(?:"((?:[^"\\]|\\.)*)"|'([^']*)'|([^\s"',;{}\[\]][^,;{}\[\]]*?))\s*(?=[,;}\n]|\Z)""")


def key_paths(ext: str, code: str) -> list[tuple[tuple, int, int]]:
    """(key path, start, end) of the values of a configuration file, see entries."""
    return [x[:3] for x in entries(ext, code)]


def _block(code: str, at: int, indent: int) -> tuple[int, int] | None:
    """The span of the lines from an offset on that are indented deeper, without the first one's indentation."""
    first = end = None
    for m in _LINE.finditer(code, at):
        line = m.group()
        if line.strip():
            if len(line) - len(line.lstrip(" ")) <= indent:
                break
            first, end = m.start() + len(line) - len(line.lstrip()) if first is None else first, m.start() + len(line.rstrip())
        elif not line:
            break
    return None if first is None else (first, end)


def entries(ext: str, code: str) -> list[tuple[tuple, int, int, object]]:
    """(key path, start, end, group) of the values of a configuration file, by its format's sections, nesting and quotes.

    Formats: .env and .sh assignments, .ini, .properties and .toml with sections, .yml and .yaml by indentation, .json and
    .tf by braces. Offsets are of the bare value, without quotes and comments at the line's end, and from the first to the
    last line of a block scalar, whose lines are also read as they stand. Values of one item, section or pair of braces
    have the same group.
    """
    if ext == "json":
        return _json_paths(code)
    if ext == "xml" or code.lstrip()[:1] == "<":
        return _xml_paths(code)
    out: list = []
    path: list = []  # (indentation or brace depth, key)
    last = None  # the value that a deeper line may go on with: (names, start, group, indentation)
    group = at = 0
    items: list = []  # (indentation of an item's keys, group) of YAML
    for m in _LINE.finditer(code):
        line = m.group()
        if not line:
            break
        start, at = m.start(), m.end()
        bare = line.strip()
        if not bare or bare[0] in "#;" or bare.startswith("//"):
            continue
        if ext in ("ini", "toml", "properties", "cfg", "conf") and bare[0] == "[" and bare[-1] == "]":
            path = [(0, bare.strip("[] \"'"))]
            group = start
            continue
        if last is not None and (code[last[1] : start].rstrip(" \t\r\n")[-1:] == "\\" and ext not in ("yml", "yaml", "tf") or ext in ("ini", "cfg", "conf") and len(line) - len(line.lstrip()) > last[3]):
            names, a, g, _ = last  # the line goes on with the value before
            out[:] = [x for x in out if x[1] != a]
            a = a if code[a] not in " \t\r\n" else start + len(line) - len(line.lstrip())
            out.append((names, a, start + len(line.rstrip()), g))
            last = (names, a, g, last[3])
            continue
        last = None
        kv = _KV.match(line.rstrip("\r\n"))
        if ext in ("yml", "yaml") and bare[0] == "-" and path and (item := _ITEM.match(line)) is not None:
            depth = len(line) - len(line.lstrip(" "))
            names = tuple(p[1] for p in path if p[0] < depth or p[0] == depth and p is path[-1])
            k = next(k for k in (1, 2, 3) if item.group(k) is not None)
            if names:
                out.append(((*names[:-1], names[-1].removesuffix("s")), start + item.start(k), start + item.end(k), start))
            continue
        if kv is None:
            if bare[0] in "}])" and path and ext == "tf":
                path.pop()
                group = start
            elif ext == "tf" and bare.endswith("{"):
                path.append((0, bare[:-1].strip()))
                group = start
            elif ext in ("tf", "yml", "yaml") and "{" in bare:
                head = bare[: bare.index("{")].strip(" -=:\"'")
                _flow((*(p[1] for p in path), *[head][: bool(head)]), code, code.index("{", start), m.end(), out)
            continue
        indent, key, value = len(kv.group(1)), kv.group(2), kv.group(4)
        if ext in ("yml", "yaml"):
            while path and path[-1][0] >= indent:
                path.pop()
            keys_at = indent + len(line[indent:]) - len(line[indent:].lstrip("- "))
            while items and (items[-1][0] > keys_at or keys_at > indent and items[-1][0] == keys_at):
                items.pop()
            if not items or items[-1][0] < keys_at:
                items.append((keys_at, start))
            group = items[-1][1]
        names = (*(p[1] for p in path), key)
        if not value or value in ("{", "[") or ext == "tf" and value[-1] in "{[(" or ext in ("yml", "yaml") and _BLOCK.fullmatch(value):
            if ext in ("yml", "yaml", "tf"):
                path.append((indent, key))
                if ext == "tf":
                    group = start
                elif value and value[0] in "|>" and (span := _block(code, at, indent)) is not None:
                    out.append((names, *span, group))
            elif not value:
                last = (names, m.start() + kv.end(3), group, indent)
            continue
        if value[0] == "{" and ext in ("tf", "yml", "yaml", "toml"):
            _flow(names, code, start + kv.start(4), m.end(), out)
        a = start + kv.start(4)
        b = a + len(value)
        if value[0] == "[" and ext in ("yml", "yaml", "toml", "tf"):
            _listed((*names[:-1], key.removesuffix("s")), code, a, b, out)
            continue
        last = (names, a, group, indent)
        if value[0] in "\"'" and (close := value.find(value[0], 1)) > 0:
            a, b = a + 1, a + close
        elif ext in ("yml", "yaml", "toml", "env", "sh", "tf", "ini") and (hash_at := re.search(r"\s[#;]", value)):
            b = a + hash_at.start()
        out.append((names, a, b, group))
    return out


def _flow(names: tuple, code: str, at: int, end: int, out: list) -> None:
    """Add the pairs in braces within one line, each pair of braces a group."""
    for m in _FLOW.finditer(code, at, end):
        k = next(k for k in (2, 3, 4) if m.group(k) is not None)
        out.append(((*names, m.group(1)), *m.span(k), (code.rfind("{", at, m.start()),)))


#: An item of a list in YAML without a key of its own.
_ITEM = re.compile(r"""[ ]*-[ \t]+(?:"((?:[^"\\\n]|\\.)*)"|'([^'\n]*)'|([^\s"'\[{&*!|>#-](?:(?!:\s|:\Z)[^\n])*?))[ \t]*(?:\s#[^\n]*)?\r?\n?\Z""")
_ELEMENT = re.compile(r"""\s*(?:"((?:[^"\\\n]|\\.)*)"|'([^'\n]*)'|([^\s,"'\[\]{}][^,\[\]{}\n]*?))\s*(?:,|\]|\Z)""")


def _listed(names: tuple, code: str, at: int, end: int, out: list) -> None:
    """Add the elements of a list in brackets within one line."""
    at += 1
    while (m := _ELEMENT.match(code, at, end)) is not None and m.end() > at:
        k = next(k for k in (1, 2, 3) if m.group(k) is not None)
        out.append((names, *m.span(k), (at,)))
        at = m.end()


_XML = re.compile(r"""<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[([\s\S]*?)(?:\]\]>|\Z)|<\?[\s\S]*?(?:\?>|\Z)|<!(?!--|\[)[^>]*>?|</[^>]*>?|<([\w:.-]+)((?:[^<>"']|"[^"]*"|'[^']*')*)>?|([^<]+)""")
_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def _xml_paths(code: str) -> list[tuple[tuple, int, int, object]]:
    """(key path, start, end, group) of the texts and attributes of XML; attributes of one element are siblings, and an
    element's text goes by its name attribute if it has one."""
    out: list = []
    path: list = []
    for m in _XML.finditer(code):
        t = m.group()
        if m.group(2):
            name, named = m.group(2), None
            for x in _ATTRIBUTE.finditer(code, m.start(3), m.end(3)):
                k = 2 if x.group(2) is not None else 3
                out.append(((*path, name, x.group(1)), *x.span(k), (m.start(),)))
                named = x.group(k) if x.group(1).lower() in ("name", "key", "id") else named
            if not m.group(3).rstrip().endswith("/"):
                path.append(named or name)
        elif t.startswith("</"):
            path = path[:-1]
        elif path and (m.group(1) or m.group(4)):
            a, b = m.span(1 if m.group(1) is not None else 4)
            text = code[a:b]
            if text.strip():
                out.append((tuple(path), a + len(text) - len(text.lstrip()), a + len(text.rstrip()), (a,)))
    return out


_JSON = re.compile(r'"((?:[^"\\\n]|\\.)*)"|[{}\[\]:,]')


def _json_paths(code: str) -> list[tuple[tuple, int, int, object]]:
    """(key path, start, end, start of the braces) of every text in JSON, of broken JSON as far as it can be read."""
    out: list = []
    path: list = [None]
    opened: list = [0]
    text, before = None, "{"  # a text that is no key yet, and the sign before it
    for m in _JSON.finditer(code):
        t = m.group()
        if t == ":" and text is not None:
            path[-1] = text[0].group(1)
            text, before = None, t
            continue
        if text is not None and text[1] in ":[," and path[-1] is not None:
            out.append((tuple(p for p in path if p), *text[0].span(1), opened[-1]))
        text = None
        if t[0] == '"':
            text = (m, before)
        elif t in "{[":
            path.append(path[-1].removesuffix("s") if t == "[" and path[-1] else None)
            opened.append(m.start())
        elif t in "}]" and len(path) > 1:
            path.pop()
            opened.pop()
        before = t[0]
    if text is not None and text[1] in ":[," and path[-1] is not None:
        out.append((tuple(p for p in path if p), *text[0].span(1), opened[-1]))
    return out


def _secret_name(path: tuple, sibling: str | None, bare: bool) -> bool:
    """Whether the last key is a secret's; a key that says nothing goes by its sibling's name or the nearest key above that
    says something. bare: the value may be an expression or anchor, so that its own key must say it."""
    last = path[-1].replace(" ", "_")
    if sensitive(last) or bare or not _GENERIC.match(last):
        return sensitive(last)
    if sibling is not None and (HARMLESS.search(sibling) or SENSITIVE.search(sibling)):
        return sensitive(sibling)
    above = next((p for p in reversed(path[:-1]) if not _GENERIC.match(p)), "")
    return sensitive(re.split(r"[\s\"']+", above.strip(" \"'"))[-1])


def in_configuration(ext: str, code: str) -> list[tuple[int, int, list]]:
    out: list = []
    blocks: list = []
    got = entries(ext, code)
    siblings = {g: code[a:b] for path, a, b, g in got if _NAMING.match(path[-1]) and b - a < 80}
    for path, a, b, g in got:
        value = code[a:b]
        if len(value) < 4 or value.startswith("data:"):
            continue
        inner = _inside(value)
        if "\n" in value:
            inner = _apart(inner + _by_line(value, inner))
            if not inner and _secret_name(path, siblings.get(g), False):
                joined = re.sub(r"\\\r?\n\s*", "", value)
                if "\n" not in joined:
                    inner = [(0, len(value))] if secret_shape(joined) else []
                else:
                    inner = [(x + len(y) - len(y.lstrip()), x + len(y.rstrip())) for x, z in _pieces(value) if secret_shape(y := value[x:z])]
            blocks += [(a + x, a + y, []) for x, y in inner]
            continue
        if inner:
            out += [(a + x, a + y, []) for x, y in inner]
            continue
        if (d := re.fullmatch(r"\$\{\w+:?[-=]([^}]+)\}", value)) is not None:
            a, value = a + d.start(1), d.group(1)
            b = a + len(value)
        if _secret_name(path, siblings.get(g), ext == "tf" and code[a - 1 : a] not in ("\"", "'") or value[0] in "*&!") and (secret_shape(value) or passphrase(path[-1], value)):
            out.append((a, b, []))
    taken = sorted(x[:2] for x in out)
    out += [x for x in blocks if not ((k := bisect_right(taken, (x[0], len(code)))) and taken[k - 1][1] > x[0])]
    covered = [(a, b) for a, b, _ in out]
    at = 0
    for line in code.split("\n"):
        bare = line.lstrip()
        if bare[:1] in ("#", ";") or bare[:2] == "//":
            _comment(line, at, out)
        elif ext == "sh" and " -" in line:  # values on a command line
            out += [(at + m.start(1), at + m.end(1), []) for p in _NOTE[1:] for m in p.finditer(line) if secret_shape(m.group(1), loose=False)]
        elif "-----BEGIN" in line and PRIVATE.search(line) and not any(at <= a <= at + len(line) for a, _ in covered):
            m = _PEM.search(code, at)
            if m and MASK not in m.group(2):
                out.append((m.start(1), m.end(2), []))
        at += len(line) + 1
    return out


def find(ext: str, code: str) -> list[tuple[int, int, list]]:
    """All credentials of one file in order, apart from each other."""
    found = in_source(ext, code) if ext in LANGUAGES else in_configuration(ext, code)
    found.sort(key=lambda x: (x[0], x[1]))
    out: list = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def byte_offsets(code: str, at: list[int]) -> list[int]:
    """Offsets in the bytes of UTF-8 of offsets in characters, given in order; unpaired surrogates count as three bytes."""
    if code.isascii():
        return at
    out, done, size = [], 0, 0
    for i in at:
        size += len(code[done:i].encode("utf-8", "surrogatepass"))
        done = i
        out.append(size)
    return out


def redact(code: str, found: list[tuple[int, int, list]]) -> str:
    """Splice the mask over each value and empty the further parts of joined values; all other bytes stay as they are."""
    spans = sorted([(a, b, MASK) for a, b, _ in found] + [(a, b, "") for _, _, more in found for a, b in more])
    cuts: list = []
    for a, b, text in spans:
        if cuts and a < cuts[-1][1]:
            continue
        if (m := PRIVATE.match(code, a)) is not None:  # keep the marks of a key, mask its body
            end = code.find("-----END", a, b)
            glue = _GLUE.match(code, m.end()).group()
            text = m.group() + glue + MASK + (glue + code[end:b] if end >= 0 else "")
        cuts.append((a, b, text))
    ends = byte_offsets(code, [x for a, b, _ in cuts for x in (a, b)])
    raw, out, at = code.encode("utf-8", "surrogatepass"), [], 0
    for (_, _, text), a, b in zip(cuts, ends[::2], ends[1::2], strict=True):
        out += [raw[at:a], text.encode()]
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def credentials(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, line_no): one row for each line on which a credential's value begins; lines are cut at line feeds, from 1.

    Each file is one row and is judged alone where it is read, without a shuffle. Null and empty codes and null paths
    give nothing (without a path the file counts as configuration). Extra columns don't matter.
    """
    kind = files.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, lines = [], []
            for i, ext, code in zip(b[key], b["ext"], b["code"], strict=True):
                found = find(ext or "", code)
                if found:
                    ends = [m.start() for m in re.finditer("\n", code)]
                    for line in sorted({bisect_right(ends, a - 1) + 1 for a, _, _ in found}):
                        keys.append(i)
                        lines.append(line)
            yield pd.DataFrame({key: pd.Series(keys, dtype=b[key].dtype), "line_no": pd.Series(lines, dtype="int32")})

    rows = files.select(F.col(key), extension().alias("ext"), "code").where(F.length("code") > 0)
    return spread(rows).mapInPandas(scan, f"`{key}` {kind}, line_no int")


def spans(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, line_no, byte_start, byte_end): the place of each credential in the bytes of the file's UTF-8, several of one line
    included; of a value joined from parts, the first. Judged as by credentials."""
    kind = files.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, ext, code in zip(b[key], b["ext"], b["code"], strict=True):
                if found := find(ext or "", code):
                    ends = [m.start() for m in re.finditer("\n", code)]
                    at = byte_offsets(code, [x for a, z, _ in found for x in (a, z)])
                    rows += [(i, bisect_right(ends, a - 1) + 1, x, y) for (a, _, _), x, y in zip(found, at[::2], at[1::2], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "line_no", "byte_start", "byte_end"])

    rows = files.select(F.col(key), extension().alias("ext"), "code").where(F.length("code") > 0)
    return spread(rows).mapInPandas(scan, f"`{key}` {kind}, line_no int, byte_start long, byte_end long")


def redacted(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, code, n_redacted) of every file; without a credential, and for null codes, the code comes out as it was."""
    kind = files.schema[key].dataType.simpleString()

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find(e or "", c) if c else [] for e, c in zip(b["ext"], b["code"], strict=True)]
            yield pd.DataFrame({key: b[key], "code": [redact(c, f) if f else c for c, f in zip(b["code"], found, strict=True)], "n_redacted": [len(f) for f in found]})

    return files.select(F.col(key), extension().alias("ext"), "code").mapInPandas(mask, f"`{key}` {kind}, code string, n_redacted int")
