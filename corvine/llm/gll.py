"""Generalised LL recognition with a graph-structured stack, over token sequences whose bracket groups are single tokens.

A token is a kind (str) or the number of an interned bracket group (int). Interning makes equal groups the same number,
so the answer to "does this group derive that nonterminal" is remembered per (nonterminal, token sequence) and shared by
all files a task sees: code repeats few shapes of statements, and only a new shape is parsed at all.

Grammar notation, one rule per line: ``Name = alternatives``; ``'x'`` and UPPER words are token kinds; ``P:X``, ``B:X``
and ``C:X`` are groups in parentheses, brackets or braces whose content derives X; ``$`` is the end of the content;
``( ) | * + ?`` as usual. ``%list Outer Element sep`` declares that contents of Outer may be tried piece by piece first.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_SYMBOL = re.compile(r"\s*(?:('(?:[^'])+')|([PBC]):(\w+)|(\w+)|(\$)|([()|*+?]))")
_OPEN = {"P": "(", "B": "[", "C": "{"}
#: Remembered shapes and groups per Python worker; at this number the tables start anew.
MEMO_LIMIT = 250_000


class Groups:
    """Interned bracket groups of one worker."""

    def __init__(self) -> None:
        self.ids: dict = {}
        self.of: list = []

    def intern(self, bracket: str, content: tuple) -> int:
        key = (bracket, content)
        n = self.ids.get(key)
        if n is None:
            n = self.ids[key] = len(self.of)
            self.of.append(key)
        return n


class Grammar:
    def __init__(self, text: str) -> None:
        self.rules: dict[str, list[tuple]] = {}
        self.lists: dict[str, tuple[str, str]] = {}
        for line in text.strip().splitlines():
            line = line.strip()
            if line.startswith("%list"):
                _, outer, element, sep = line.split()
                self.lists[outer] = (element, sep)
            elif line and not line.startswith("#"):
                name, _, body = line.partition(" = ")
                self.rules.setdefault(name.strip(), []).extend(self._alternatives(name.strip(), body))
        self._index()
        self.memo: dict = {}

    def _alternatives(self, owner: str, body: str) -> list[tuple]:
        toks = [m.groups() for m in _SYMBOL.finditer(body)]
        pos, fresh = 0, iter(range(1 << 30))

        def new(alts: list[tuple]) -> tuple:
            name = f"{owner}.{len(self.rules)}.{next(fresh)}"
            self.rules[name] = alts
            return ("n", name)

        def alts() -> list[tuple]:
            nonlocal pos
            out = [seq()]
            while pos < len(toks) and toks[pos][5] == "|":
                pos += 1
                out.append(seq())
            return out

        def seq() -> tuple:
            nonlocal pos
            out: list = []
            while pos < len(toks) and toks[pos][5] not in ("|", ")"):
                lit, br, inner, word, end, op = toks[pos]
                pos += 1
                if lit:
                    sym = ("t", lit[1:-1])
                elif br:
                    sym = ("g", _OPEN[br], inner)
                elif word:
                    sym = ("t", word) if word.isupper() else ("n", word)
                elif end:
                    sym = ("e",)
                else:
                    sym = new(alts())
                    pos += 1
                while pos < len(toks) and toks[pos][5] in ("*", "+", "?"):
                    op, pos = toks[pos][5], pos + 1
                    if op == "?":
                        sym = new([(), (sym,)])
                    else:
                        star = new([])
                        self.rules[star[1]] = [(), (sym, star)]
                        if op == "+":
                            out.append(sym)
                        sym = star
                out.append(sym)
            return tuple(out)

        return alts()

    def _index(self) -> None:
        """First kinds of every alternative; an alternative that may be empty is always tried."""
        first: dict[str, set] = {n: set() for n in self.rules}
        empty: set[str] = set()
        changed = True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                for alt in alts:
                    f, e = self._first(alt, first, empty)
                    if not f <= first[n] or (e and n not in empty):
                        first[n] |= f
                        empty |= {n} if e else set()
                        changed = True
        self.firsts = {n: [(alt, *self._first(alt, first, empty)) for alt in alts] for n, alts in self.rules.items()}
        self.predicted: dict = {}

    @staticmethod
    def _first(alt: tuple, first: dict, empty: set) -> tuple[set, bool]:
        out: set = set()
        for sym in alt:
            if sym[0] == "t":
                return out | {sym[1]}, False
            if sym[0] == "g":
                return out | {sym[1]}, False
            if sym[0] == "e":
                return out | {None}, False
            out |= first[sym[1]]
            if sym[1] not in empty:
                return out, False
        return out, True

    def predict(self, name: str, kind: str | None) -> list[tuple]:
        key = (name, kind)
        got = self.predicted.get(key)
        if got is None:
            got = self.predicted[key] = [alt for alt, f, e in self.firsts[name] if e or kind in f]
        return got

    def derives(self, name: str, content: tuple, groups: Groups) -> bool:
        """Whether the nonterminal derives exactly this content."""
        key = (name, content)
        got = self.memo.get(key)
        if got is None:
            listed = self.lists.get(name)
            if listed and len(content) > 3:
                got = self._pieces(name, listed, content, groups) or (listed[1] == "," and self._gll(name, content, groups))
            else:
                got = self._gll(name, content, groups)
            self.memo[key] = got
        return got

    def _pieces(self, name: str, listed: tuple[str, str], content: tuple, groups: Groups) -> bool:
        """Whether the content derives the list: pieces that alone derive the element need no more; around a piece that
        doesn't, pieces are joined, and at last the content is parsed as it is from two whole elements before that piece
        on. Of comma lists a no means nothing yet."""
        element, sep = listed
        if sep == ",":
            pieces, at = set(), 0
            for i, t in enumerate(content):
                if t == ",":
                    pieces.add(content[at:i])
                    at = i + 1
            if at < len(content):
                pieces.add(content[at:])
            for p in pieces:  # a plain loop, as builtins that call back are bounded in depth
                if not p or not self.derives(element, p, groups):
                    return False
            return True
        spans = statements(content, groups)
        cuts = [content[a:b] for a, b in spans]
        for p in set(cuts):
            if not self.derives(element, p, groups):
                break
        else:
            return True
        i, n = 0, len(cuts)
        while i < n:
            if self.derives(element, cuts[i], groups):
                i += 1
                continue
            for k in range(2, 6):  # a cut inside a statement: pieces that make one together
                if i + k <= n and self.derives(element, content[spans[i][0] : spans[i + k - 1][1]], groups):
                    i += k
                    break
            else:
                return self._gll(name, content[spans[max(0, i - 2)][0] :], groups)
        return True

    def _gll(self, name: str, toks: tuple, groups: Groups) -> bool:
        n = len(toks)
        kinds = [t if t.__class__ is str else groups.of[t][0] for t in toks]
        kinds.append(None)
        nodes: dict = {}  # graph-structured stack: (nonterminal, position) -> (end positions, continuations)
        work: list = []
        seen: set = set()
        top: tuple = ([], [])
        nodes[name, 0] = top
        for alt in self.predict(name, kinds[0]):
            work.append((alt, 0, top, 0))
        while work:
            alt, i, node, pos = work.pop()
            while True:
                if i == len(alt):
                    ends = node[0]
                    if pos not in ends:
                        ends.append(pos)
                        if node is top and pos == n:
                            return True
                        for a, j, parent in node[1]:
                            key = (id(a), j, id(parent), pos)
                            if key not in seen:
                                seen.add(key)
                                work.append((a, j, parent, pos))
                    break
                sym = alt[i]
                what = sym[0]
                if what == "t":
                    if kinds[pos] != sym[1]:
                        break
                    i, pos = i + 1, pos + 1
                elif what == "g":
                    t = toks[pos] if pos < n else None
                    if kinds[pos] != sym[1] or t.__class__ is str or not self.derives(sym[2], groups.of[t][1], groups):
                        break
                    i, pos = i + 1, pos + 1
                elif what == "e":
                    if pos != n:
                        break
                    i += 1
                else:
                    key = (sym[1], pos)
                    child = nodes.get(key)
                    if child is None:
                        child = nodes[key] = ([], [(alt, i + 1, node)])
                        for a in self.predict(sym[1], kinds[pos]):
                            work.append((a, 0, child, pos))
                    else:
                        child[1].append((alt, i + 1, node))
                        for end in child[0]:
                            k = (id(alt), i + 1, id(node), end)
                            if k not in seen:
                                seen.add(k)
                                work.append((alt, i + 1, node, end))
                    break
        return False


_HEADS = {"for", "if", "switch", "while"}
_GO_ON = set("else catch finally while ; , . ?. ( [ = + - * / % & | ^ < > ? : == === != !== && || ?? ++ -- => -> :: instanceof in of as satisfies from".split())


def _block_follows(content: tuple, i: int, blocks: list[int]) -> bool:
    """Whether a head's block stands behind its semicolon, with one more of them between at most."""
    k = bisect_right(blocks, i)
    return k < len(blocks) and content[i + 1 : blocks[k]].count(";") <= 1


def statements(content: tuple, groups: Groups) -> list[tuple[int, int]]:
    """Spans of statements: cut behind semicolons, line ends and blocks that nothing continues; heads with semicolons stay whole."""
    out, at, last, n = [], 0, len(content) - 1, len(content)
    blocks = [i for i, t in enumerate(content) if t.__class__ is int and groups.of[t][0] == "{"] if ";" in content else []
    for i, t in enumerate(content):
        if t.__class__ is int:
            if i < last and groups.of[t][0] == "{":
                nxt = content[i + 1]
                nxt = nxt if nxt.__class__ is str else groups.of[nxt][0]
                if nxt != "NL" and nxt not in _GO_ON:
                    out.append((at, i + 1))
                    at = i + 1
        elif t == ";" or t == "NL":
            if t == ";" and content[at] in _HEADS and not (content[i - 1].__class__ is int and groups.of[content[i - 1]][0] == "{") and _block_follows(content, i, blocks) and content[at + 1].__class__ is not int:
                continue
            if t == "NL" and i < last and content[i + 1] in ("else", "catch", "finally"):
                continue
            block = t == "NL" and i > at and content[i - 1].__class__ is int and groups.of[content[i - 1]][0] == "{"
            out.append((at, i if block else i + 1))  # a line end behind a block ends nothing
            at = i + 1
    if at < n:
        out.append((at, n))
    return out
