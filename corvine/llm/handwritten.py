"""Generated, minified, vendored and data files among source files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.common import cut, spread
from corvine.llm.syntax import LANGUAGES, extension, parses

#: Markers of notices in comments, in small letters, by what they speak of: that something is generated, that it
#: isn't to be edited, this file, a ban on taking it so, a whole notice, a licence, a foreign origin.
MARKERS = {
    "generated": "generated|autogenerated|auto-generated|auto generated|machine-generated|machine generated|machine-made|generiert|erzeugt|généré|produit par|generado|gerado|generato|gegenereerd",
    "hands off": "do not edit|do not modify|do not change|do not alter|don't edit|don't modify|not be edited|changes will be lost|edits will be lost|will be overwritten|changes are overwritten|edits are overwritten|nicht bearbeiten|nicht ändern|wird beim nächsten lauf überschrieben|ne pas le modifier|ne pas modifier|ne pas éditer|no lo modifique|no modificar|no editar|não o altere|não edite|não editar|non modificarlo|non modificare|niet wijzigen|niet met de hand wijzigen|niet bewerken",
    "this file": "this file|this code|this class|this module|this source|this document|this script|file generated|code generated|source generated|generated file|generated code|generated source|dieser quelltext|diese datei|ce fichier|este archivo|este ficheiro|este arquivo|questo file|dit bestand",
    "not so": "not generated|isn't generated|aren't generated|never generated|not auto-generated|not autogenerated|nicht generiert|nicht erzeugt|pas généré|no generado|não gerado|non generato|niet gegenereerd|edit it freely",
    "notice": "<auto-generated|<autogenerated|@generated|ce fichier est produit par|datei wird erzeugt|automatisch generiert|automatisch erzeugt|automatisch gegenereerd|généré automatiquement|generado automáticamente|gerado automaticamente|generato automaticamente|este archivo ha sido generado|este archivo fue generado|questo file è stato generato|quelltext wurde von|diese datei wurde von|ce fichier a été généré|fichier généré|archivo generado por|este ficheiro foi gerado|este arquivo foi gerado|questo file è generato|dit bestand is gegenereerd",
    "licence": "mit license|mit licence|apache license|apache-2.0|bsd license|bsd-2-clause|bsd-3-clause|mozilla public license|general public license|lesser general public|isc license|boost software license|permission is hereby granted|redistribution and use in source and binary|spdx-license-identifier: mit|spdx-license-identifier: isc|spdx-license-identifier: mpl|spdx-license-identifier: gpl|spdx-license-identifier: lgpl|spdx-license-identifier: 0bsd|released under the mit|jquery.org/license",
    "foreign": "the upstream authors|terms of the upstream|upstream permissive licence|mit-like licence|vendored from|taken over from http|imported from upstream|copied verbatim from|@license",
}
#: What says that a file itself was generated: a subject and a passive, or a line that begins so.
_PASSIVE = re.compile(r"\b(?:this|the following)\s+(?:[\w-]+\s+){0,2}?(?:was|is|has been|were|are)\s+(?:\w+ly\s+|auto[- ]?|machine[- ]?)*(?:generated|autogenerated|created|produced|machine-made)\s*(?:[.,;:!]|by\b|from\b|with\b|using\b|on\b|at\b|$)|^(?:\w+\s+)?(?:file|code|source)\s+(?:was\s+|is\s+)?(?:\w+ly\s+|auto[- ]?)?(?:generated|produced)\b")
_BEGINS = re.compile(r"(?:\w+ly\s+|auto[- ]?|machine[- ]?)?(?:generated|made)(?:\s+\w+ly)?\s+(?:by|from|with|using|via|on|at)\s+(the\b|an?\b|our\b|this\b)?|(?:\w+ly\s+|auto[- ]?|machine[- ]?)?generated\s*(?:file|code|source)?\s*(?:[.;:!,]|--?\s|$)")
_VERSIONED = re.compile(r"\bv?\d+\.\d+(?:\.\d+)?\b.*(?:licen[sc]e|\(c\)|©)|(?:licen[sc]e|\(c\)|©).*\bv?\d+\.\d+\.\d+\b", re.I)
_OWNER = re.compile(r"(?:copyright|\(c\)|©|spdx-filecopyrighttext:)\s*(?:\(c\)|©)?[\s\d,–-]*(?:by\s+)?([^\n|]{3,})", re.I)
_DECORATION = re.compile(r"^[\s/*#!=~+\-\"']+|[\s*/=~\"']+$")
#: Folders of foreign and of generated code, and file names of tools' output.
FOREIGN_FOLDERS = frozenset("vendor node_modules bower_components jspm_packages third_party thirdparty third-party 3rdparty external externals site-packages dist-packages deps _vendor vendored pods carthage godeps".split())
GENERATED_FOLDERS = frozenset("__generated__ generated-sources generated generated-src gen-src autogen dist".split())
GENERATED_NAMES = re.compile(r"(?:\.min|\.bundle|\.generated|\.pb|\.pb\.gw|\.g|[._-]gen|_generated|_pb2|_pb2_grpc|\.designer|\.chunk|\.packed)\.\w+$|^zz_generated|^bindata\.go$", re.I)
#: Lockfiles, which package tools write.
LOCKFILES = re.compile(r"^(?:package-lock\.\w+|npm-shrinkwrap\.json|pnpm-lock\.\w+|yarn\.lock|bun\.lockb?|composer\.lock|gemfile\.lock|cargo\.lock|poetry\.lock|pipfile\.lock|pdm\.lock|uv\.lock|go\.sum|gradle\.lockfile|podfile\.lock|pubspec\.lock|mix\.lock|flake\.lock|packages\.lock\.json|\.terraform\.lock\.hcl)$", re.I)
FOREIGN_NAMESPACES = re.compile(r"(?:^|[:/])(?:third[-_]party|thirdparty|3rdparty|vendored|upstream|external)[-_](?:mirror|copies|copy|code|libs?|deps|sources?)(?:$|[:/])|(?:^|[:/])(?:vendored|node_modules|thirdparty|third[-_]party)$", re.I)

_AUTOMATON: dict = {}
_LEAD = {"py": re.compile(r"(?:\s+|#[^\n]*)*")}
_LEAD_C = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/|#![^\n]*)*")
_STRINGS = re.compile(r"""\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`""")
_COMMENTS = {"py": re.compile(r"#[^\n]*")}
_COMMENTS_C = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/")
_LITERALS = re.compile(r"""(?<![\w$])[-+]?(?:0[xX][0-9a-fA-F_]+|\d[\d_.]*(?:[eE][-+]?\d+)?)[A-Za-z]?(?![\w$])|""|\b(?:null|true|false|None|True|False|nil)\b""")
_LOGIC = re.compile(r"\b(?:def|lambda|function|func|return|if|for|while|switch|try|throw|raise|import\s+\(|=>|->)\b|=>|->")
#: A line longer than this without its texts, and code with fewer blanks per character than this, is compressed.
LONG_LINE, FEW_BLANKS = 240, 0.06
#: This share of literals in the code without comments, and so many literals at least, make data; so do texts without
#: blanks of so many characters under hardly any name.
DATA_SHARE, DATA_LEAST, DATA_TEXT = 0.6, 24, 400


def _classes(text: str) -> set:
    """The kinds of the markers that a text in small letters holds, found by one automaton over all of them."""
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for kind, words in MARKERS.items():
            for w in words.split("|"):
                kinds, _ = a.get(w, ((), 0))
                a.add_word(w, ((*kinds, kind), len(w)))
        a.make_automaton()
        _AUTOMATON["a"] = a
    return {k for _, (kinds, _) in _AUTOMATON["a"].iter(text) for k in kinds}


def notice(text: str, namespace: str | None = None) -> bool:
    """Whether comments say that their file was written by a tool or comes from an outside project.

    A line is a notice if it says "generated" or "this file" and not to edit it, that this very file was generated, or
    opens with "generated by" something; a line that only speaks of generated things, or says that the file isn't
    generated, is none. A licence beside a copyright owner that isn't in the namespace's name, a banner with a version
    and a licence, and words of foreign origin mark outside files.
    """
    found = _classes(text.lower())
    if not found:
        return bool(text.startswith("/*!") and _VERSIONED.search(text[: text.find("*/")]))
    if "foreign" in found or text.startswith("/*!") and _VERSIONED.search(text[: text.find("*/")]):
        return True
    if "licence" in found:
        own = [w for w in re.split(r"[^a-z0-9]+", (namespace or "").lower()) if len(w) > 3]
        if any(not any(w in m.group(1).lower() for w in own) for m in _OWNER.finditer(text)):
            return True
    if not found & {"generated", "hands off", "notice"}:
        return False
    lines = [_DECORATION.sub("", x) for x in text.lower().split("\n")]
    for i, line in enumerate(lines):
        here = _classes(line)
        if not here & {"generated", "hands off", "notice"} or "not so" in here:
            continue
        if "notice" in here or _PASSIVE.search(line):
            return True
        near = here | (_classes(lines[i - 1]) if i else set()) | (_classes(lines[i + 1]) if i + 1 < len(lines) else set())
        if "hands off" in here and here & {"generated", "this file"} or {"hands off", "generated"} <= near and here & {"this file"}:
            return True
        if (m := _BEGINS.match(line)) is not None and (not m.group(1) or "hands off" in near):
            return True
    return False


def place(path: str, namespace: str | None) -> bool:
    """Whether the folders, the file's name or the namespace say that the file is foreign or generated."""
    parts = path.replace("\\", "/").split("/")
    folders = {p.lower() for p in parts[:-1]}
    return bool(folders & FOREIGN_FOLDERS or folders & GENERATED_FOLDERS or GENERATED_NAMES.search(parts[-1]) or LOCKFILES.match(parts[-1]) or (namespace and FOREIGN_NAMESPACES.search(namespace)))


def header(ext: str, code: str) -> tuple[str, int]:
    """The comments at the head, with a Python module's text, and at the foot; and where the head's comments end."""
    m = (_LEAD.get(ext) or _LEAD_C).match(code)
    end = m.end()
    head = code[:end]
    if ext == "py" and (t := _STRINGS.match(code, end)) and t.group().startswith(('"""', "'''")):
        head += t.group()
    stop = len(code.rstrip())
    if code.endswith("*/", end, stop) and ext != "py":
        head += "\n" + code[max(end, code.rfind("/*", end, stop)) : stop]
    else:
        mark = "#" if ext == "py" else "//"
        at = stop
        while at > end:  # from the last line up, as long as lines are comments
            first = max(end, code.rfind("\n", end, at) + 1)
            line = code[first:at].strip()
            if not line.startswith(mark):
                break
            head += "\n" + line
            at = first - 1
    return head, end


def looks_made(ext: str, code: str) -> bool:
    """Compressed for shipping, or data instead of code."""
    bare = (_COMMENTS.get(ext) or _COMMENTS_C).sub("", _STRINGS.sub('""', code))
    solid = bare.strip()
    if not solid:
        return False
    longest = max(map(len, solid.split("\n")))
    if longest > LONG_LINE and ext != "go" and sum(c.isspace() for c in solid) < FEW_BLANKS * len(solid):
        return True
    logic = _LOGIC.search(solid)
    if not logic and len(re.findall(r"[A-Za-z_$][\w$]*", solid)) <= 6:
        texts = "".join(m.group() for m in _STRINGS.finditer(code))
        if len(texts) >= max(DATA_TEXT, DATA_SHARE * len(code)) and sum(c.isspace() for c in texts) < 0.05 * len(texts):
            return True
    n = 0

    def count(m: re.Match) -> str:
        nonlocal n
        n += 1
        return ""

    rest = re.sub(r"[\s,\[\]{}();:]+", "", _LITERALS.sub(count, solid))
    if n < DATA_LEAST or logic:
        return False
    whole = re.sub(r"\s+", "", solid)
    return len(rest) <= (1 - DATA_SHARE) * len(whole) or n >= 6 * len(re.findall(r"[A-Za-z_$][\w$]*(?!\s*:|[\w$])", solid))


def body_key(ext: str, code: str, end: int) -> bytes | None:
    """A digest of the text behind its leading comments, without blank space; null for nothing."""
    body = "".join(code[end:].split())
    return hashlib.blake2b(f"{ext}\n{body}".encode(), digest_size=16).digest() if body else None


def not_handwritten(files: DataFrame, key: str = "file_id", least: int = 3) -> DataFrame:
    """(key, reason) of source files not written by hand for their service; reason: notice, place, made or copied.

    notice: a comment at the head or foot says so (multi-pattern automaton); place: path, file name or namespace; made:
    compressed or data; copied: the same body lies under ``least`` or more namespaces (null namespaces aren't counted).
    The first that holds is given. Empty files and files of blank space or comments alone are hand-written unless by
    notice or place; a file that doesn't parse is a case by notice or place only. Null paths and codes give nothing.

    One pass judges each file by itself, and its verdicts and digests are kept in the shared folder; only digests and keys
    are shuffled for the copies, first made distinct per namespace, so a body copied a million times is no hot group.
    Copies are parsed where their files are read again.
    """
    kind = files.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, ext, path, ns, code in zip(b["_k"], b["ext"], b["file_path"], b["namespace"], b["code"], strict=True):
                head, end = header(ext, code)
                body = body_key(ext, code, end)
                reason = "place" if place(path, ns) else "notice" if notice(head, ns) else None
                if reason is None and body is not None and looks_made(ext, code) and parses(ext, code):
                    reason = "made"
                out.append((i, ns, reason, body))
            yield pd.DataFrame(out, columns=["_k", "namespace", "reason", "body"])

    def still_parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [parses(e, c) for e, c in zip(b["ext"], b["code"], strict=True)]
            yield pd.DataFrame({"_k": b["_k"][good], "reason": "copied"})

    rows = files.select(F.col(key).alias("_k"), extension().alias("ext"), "file_path", "namespace", "code").where(F.col("ext").isin(*LANGUAGES) & F.col("code").isNotNull())
    judged = cut(spread(rows).mapInPandas(judge, f"_k {kind}, namespace string, reason string, body binary"))
    wide = judged.where("body is not null and namespace is not null").select("body", "namespace").distinct().groupBy("body").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("body")
    copied = judged.where("reason is null and body is not null").join(wide, "body", "left_semi").select("_k")
    copied = rows.join(copied, "_k", "left_semi").select("_k", "ext", "code").mapInPandas(still_parse, f"_k {kind}, reason string")
    return judged.where("reason is not null").select("_k", "reason").unionByName(copied).withColumnRenamed("_k", key)
