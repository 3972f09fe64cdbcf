"""Reading one statement of C or C++: what its head declares, and the calls in it. Text without comments and literals."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words before ``(`` that are no calls, and words that a name before a declared name can't be.
CONTROL = {"if", "for", "while", "switch", "return", "sizeof", "catch", "defined", "alignof", "decltype", "static_assert", "else", "do", "new", "delete", "throw", "noexcept", "alignas", "typeid", "case", "operator"}
NO_TYPE = CONTROL | {"goto", "break", "continue", "co_return", "co_await", "co_yield", "default", "and", "or", "not", "in", "public", "private", "protected"}
#: Words that qualify a declaration.
_QUALIFIER = re.compile(r"\b(?:static|inline|virtual|explicit|constexpr|extern|friend|const|volatile|override|final|noexcept|mutable)\b")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: Characters before a name that are looked at; what stands there is a word, a type or an operator.
LOOK = 256
_ANGLES = re.compile(r"\s*<(?:[^<>]|<[^<>]*>)*>")
_ARGUED = r"(?:\s*+<(?:[\w\s:,*&]|<[\w\s:,*&]*+>)*+>)?"
_CALLED = re.compile(rf"(?<!\w)(?<!\w::)(?<!>::)((?:[A-Za-z_]\w*+{_ARGUED}::)*+~?[A-Za-z_]\w*+)\s*+(?:<(?:[\w\s:,*&]|<[\w\s:,*&]*+>)*+>\s*+)?\(|\(\s*\*\s*((?:\w++(?:\.|->))*+\w++)\s*\)\s*\(")
_LAST_NAME = re.compile(r"(?:[A-Za-z_]\w*::)*[A-Za-z_]\w*$")
_WORD_BEFORE = re.compile(r"((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)(?:\s*<[\w\s:,*&]*>)?$")
#: Attributes say nothing about what is declared.
_ATTRIBUTE = re.compile(r"__attribute__\s*\(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\)|__declspec\s*\([^()]*\)|\[\[[^\]]*\]\]")
_TYPE = re.compile(r"(?:typedef\s+)?(class|struct|union|enum(?:\s+(?:class|struct))?)\s+(?:[A-Z_]{2,}\s+(?!final\b|:))?([A-Za-z_]\w*)\s*(?:final\s*)?(?::\s*([^{]*))?\{$")
_SPACE_HEAD = re.compile(r"(?:inline\s+)?namespace\s*([\w:]*)\s*\{$|extern\s*\{$")
_ALIAS = re.compile(r"using\s+([A-Za-z_]\w*)\s*=\s*(.+);$|typedef\s+([^()]+?)\s*([A-Za-z_]\w*);$", re.S)
_VARIABLE = re.compile(r"((?:[A-Za-z_][\w:]*(?:\s*<.*>)?[\s*&]+)+)([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*(?:=.*)?[;{]?$", re.S)
#: Namespaces and classes within one another that are told apart; deeper ones count as blocks of code.
NESTED = 12
#: Fixed value: what a brace holds that opens no scope.
_CODE = "\0"
_LEAD = re.compile(r"\s*(?:(?:public|private|protected)\s*:\s*)*", re.A)
#: What opens a scope, and its name.
_OPENS = re.compile(r"\s*(?:(?:public|private|protected)\s*:\s*)*(?:template\s*<[^{}]*>\s*)?(?:typedef\s+)?(?:inline\s+)?(?:extern\b|(?:namespace|class|struct|union)\b(?:\s+[A-Z_]+(?=\s+\w))?)\s*([\w:]*)[^(){};=]*\{$", re.A)
#: A statement that is one plain call.
_PLAIN_CALL = re.compile(r"(\s*+)([A-Za-z_]\w*+)\s*+\(([\w\s,]*+)\);$")
_TAIL = re.compile(r"\s*(?:(?:const|noexcept|override|final|volatile|&&?|try)\s*|->\s*[\w:<>*&\s]+?\s*|=\s*(?:0|default|delete)\s*|:[^:].*)*[;{]$", re.S)


class Brackets:
    """The brackets of a text, read once: where each closes, how deep it lies, and the commas right inside it.

    A ``<`` after a word counts as a bracket only if its ``>`` comes before the bracket around it closes and no
    logical operator stands between. Brackets without a partner close at the end.
    """

    _MARK = re.compile(r"[()\[\]{},]|(?<=\w)<|(?<=\w )<|(?<![-=])>|&&|\|\|")

    def __init__(self, text: str):
        self.text = text
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        self.depth: dict[int, int] = {}
        self.commas: dict[int, list[int]] = {-1: []}
        # Open brackets, and below each the angles that may still turn out to be comparisons.
        held: list[tuple[str, int]] = [("", -1)]
        angles: list[list[int]] = [[]]

        def settle() -> None:
            """Angles that never closed were comparisons: their commas are those of the bracket around them."""
            for at in angles[-1]:
                self.commas[held[-1][1]].extend(self.commas.pop(at))
            angles[-1].clear()

        for mark in self._MARK.finditer(text):
            c, at = mark[0], mark.start()
            if c in "([{":
                held.append((_PAIRS[c], at))
                angles.append([])
                self.depth[at], self.commas[at] = len(held) - 2, []
            elif c in ")]}":
                if len(held) > 1 and held[-1][0] == c:
                    settle()
                    opened = held.pop()[1]
                    angles.pop()
                    self.close[opened], self.open[at] = at, opened
            elif c == ",":
                self.commas[angles[-1][-1] if angles[-1] else held[-1][1]].append(at)
            elif c == "<":
                angles[-1].append(at)
                self.commas[at] = []
            elif c == ">":
                if angles[-1]:
                    self.commas.pop(angles[-1].pop())
            elif c == "||" or not re.match(r"\s*[,>)]", text[at + 2 : at + 34]):
                settle()
        while held:
            settle()
            held.pop()
            angles.pop()

    def parts(self, opened: int, begin: int, end: int) -> list[str]:
        """The parts between the commas of a bracket (-1: of the whole text); none of blank text."""
        out = []
        for at in sorted(self.commas[opened]):
            out.append(self.text[begin:at].strip())
            begin = at + 1
        last = self.text[begin:end].strip()
        return out + [last] if out or last else []

    def arguments(self, opened: int) -> list[str]:
        stop = self.close.get(opened)
        if stop is None:
            stop = len(self.text.rstrip("{;}"))
        return self.parts(opened, opened + 1, max(stop, opened + 1))


def closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``; -1 if none does."""
    return Brackets(text).close.get(at, -1)


def split_top(text: str) -> list[str]:
    """The parts between commas that are in no brackets; none of blank text."""
    return Brackets(text).parts(-1, 0, len(text))


def pieces(text: str) -> list[str]:
    """Statements of code: each ends after ``{``, ``}`` or ``;`` that no round bracket holds.

    A round bracket holds what is in it only if it closes before the braces around it do, so one that is left open (as
    in two branches of a directive) takes no more than its own statement along.
    """
    marks = [(m.start(), m[0]) for m in re.finditer(r"[(){};]", text)]
    held, partner = [], {}
    for i, (_, c) in enumerate(marks):
        if c in "({":
            held.append(i)
        elif c == ")":
            if held and marks[held[-1]][1] == "(":
                partner[held.pop()] = i
        elif c == "}":
            while held and marks[held[-1]][1] == "(":
                held.pop()
            if held:
                held.pop()
    out, begin, until = [], 0, -1
    for i, (at, c) in enumerate(marks):
        if i <= until:
            continue
        if c == "(":
            until = partner.get(i, -1)
        elif c != ")":
            out.append(text[begin : at + 1])
            begin = at + 1
    return [*out, text[begin:]]


def declarations(text: str, spans: list[tuple[int, int, int]] = ()) -> list[tuple]:
    """The ``pieces`` of code, each outside of functions with those in the block it opens.

    (text, owner, scopes, statements) of each, in order; scopes are the names of the open namespaces and classes joined,
    owner the innermost. Its first statement is itself, the others lie in its block: (text, owner, code, base, line,
    before, states). code: some brace around is no scope's, so it lies in a function or an initialiser. base: the line
    where the text begins, line: that of its first word. before: the piece before it, if that opens a table. states: the
    greatest rank on each line of it, of the ``spans`` (first line, last line, rank from 1 to 9), empty if there is none.
    A piece in a block that nothing opened comes with a null text and no scopes.
    """
    ranks = bytearray(b"0" * (text.count("\n") + 2)) if spans else b""
    for first, last, rank in spans:
        last = min(last, len(ranks) - 1)
        ranks[first : last + 1] = bytes(max(r, 48 + rank) for r in ranks[first : last + 1])
    out, held, depth, base, before = [], [_CODE] * NESTED, 0, 1, ""
    block = None
    for piece in pieces(text):
        end = piece[-1:]
        around = held[: max(depth, 0)]
        code = depth > NESTED or _CODE in around
        named = [x for x in around if x and x != _CODE]
        lines = piece.count("\n")
        line = base + _LEAD.match(piece)[0].count("\n")
        states = ranks[base : base + lines + 1].decode() if spans else ""
        said = (piece, named[-1] if named else None, code, base, line, before, states if states.strip("0") else "")
        opens = _OPENS.match(piece) if end == "{" else None
        if not code:
            found = (piece, said[1], "::".join(named), [said])
            out.append(found)
            block = found if end == "{" and not opens else block
        elif block:
            block[3].append(said)
        else:
            out.append((None, None, "", [said]))
        if end in ("{", "}"):
            after = depth + 1 if end == "{" else depth - 1
            for d in range(max(after, 0), NESTED):
                held[d] = _CODE
            if opens and 0 <= depth < NESTED:
                held[depth] = opens[1]
            depth = after
        base, before = base + lines, piece if end == "{" and "=" in piece else ""
    return out


def parameter(text: str) -> tuple[str, str | None]:
    """(type, name or None) of a parameter, without its default."""
    text = " ".join(text.split("=")[0].split())
    found = re.match(r"(.*[\s*&>])([A-Za-z_]\w*)\s*(\[[^\]]*\])*$", text)
    if not found or found[2] in ("int", "char", "long", "short", "unsigned", "float", "double", "bool", "void", "const"):
        return text, None
    return found[1].strip(), found[2]


def _receiver(marks: Brackets, at: int, known: dict[int, str]) -> str:
    """The chain before the name at ``at``, as ``a.b().c``: brackets empty, dots only; empty if there is none.

    ``known`` holds the chains before names further left, so that a long chain is walked once.
    """
    text, parts = marks.text, []

    def back(i: int) -> int:
        while i and text[i - 1].isspace():
            i -= 1
        return i

    while at not in known:
        at = back(at)
        if text.endswith("->", 0, at):
            at = back(at - 2)
        elif text.endswith(".", 0, at):
            at = back(at - 1)
        else:
            break
        called = ""
        while at and text[at - 1] in ")]":
            opened = marks.open.get(at - 1)
            if opened is None:
                return ".".join(reversed(parts))
            called = "()" if text[at - 1] == ")" else called
            at = back(opened)
        name = _LAST_NAME.search(text[max(0, at - LOOK) : at])
        if not name:
            return ".".join(reversed(parts))
        parts.append(name[0] + called)
        at -= len(name[0])
    if known.get(at):
        parts.append(known[at])
    return ".".join(reversed(parts))


def calls_of(text: str, initialisers: bool = False) -> list[tuple[int, str, str | None, str, list[str]]]:
    """(line ends before it, kind, receiver, name, arguments) of each call, from left to right, in one pass.

    kind: free, qualified, member, chained (a member of what a call returns), constructor, function_pointer. Template
    arguments are left out of names. With ``initialisers``, the text is the head of a definition, and the calls are
    those within its list of initialisers.
    """
    plain = None if initialisers else _PLAIN_CALL.match(text)
    if plain:
        args = [a.strip() for a in plain[3].split(",")]
        return [] if plain[2] in CONTROL else [(plain[1].count("\n"), "free", None, plain[2], args if args != [""] else [])]
    out, marks, known = [], Brackets(text), {}
    ends = [m.start() for m in re.finditer("\n", text)]
    begin = 0
    if initialisers:
        params = marks.close.get(text.find("("), -1)
        found = re.compile(r"(?:\s|noexcept|const)*:(?!:)").match(text, params + 1) if params > 0 else None
        if not found:
            return []
        begin = found.end()
    for found in _CALLED.finditer(text, begin):
        opened, start = found.end() - 1, found.start()
        if initialisers and not marks.depth[opened]:
            continue
        lines = bisect_left(ends, start)
        if found[2]:
            out.append((lines, "function_pointer", None, found[2].replace("->", "."), marks.arguments(opened)))
            continue
        name = _ANGLES.sub("", found[1]) if "<" in found[1] else found[1]
        if name in CONTROL:
            continue
        before = text[max(0, start - LOOK) : start].rstrip()
        if before.endswith((".", "->")):
            receiver = known[start] = _receiver(marks, start, known)
            out.append((lines, "chained" if "(" in receiver else "member", receiver or None, name, marks.arguments(opened)))
            continue
        word = _WORD_BEFORE.search(before)
        if word and word[1] == "new":
            out.append((lines, "constructor", None, name, marks.arguments(opened)))
        elif word and word[1] not in NO_TYPE and text[start - 1 : start].isspace() and "::" not in name:
            out.append((lines, "constructor", name, word[1], marks.arguments(opened)))
        elif not before.endswith("~"):
            out.append((lines, "qualified" if "::" in name else "free", None, name, marks.arguments(opened)))
    return out


def head_of(text: str, owner: str | None) -> tuple[str, str, str, str | None, list[tuple[str, str | None]]] | None:
    """(what, name, kind, type, parameters) that a statement declares, None if nothing.

    what: scope (a namespace or extern block, kind ``namespace``), type (kind class, struct, ...; type: its bases),
    function (kind definition or declaration), alias, variable. ``owner``: the short name of the class around it, which
    its constructors have.
    """
    plain = " ".join((_ATTRIBUTE.sub(" ", text) if "_" in text or "[[" in text else text).split())
    plain = re.sub(r"^(?:(?:public|private|protected)\s*:\s*)+", "", plain)
    while plain.startswith("template"):
        depth, i = 0, plain.find("<")
        while 0 <= i < len(plain):
            depth += (plain[i] == "<") - (plain[i] == ">")
            if not depth:
                break
            i += 1
        plain = plain[i + 1 :].strip() if i >= 0 else ""
    if not plain or plain[-1] not in "{;" or len(plain) < 2:
        return None
    found = _SPACE_HEAD.match(plain)
    if found:
        return "scope", found[1] or "", "namespace", None, []
    found = _TYPE.match(plain)
    if found:
        bases = ",".join(re.sub(r"\b(?:public|private|protected|virtual)\b", "", b).strip() for b in split_top(found[3] or ""))
        return "type", found[2], found[1].split()[0], bases or None, []
    found = _ALIAS.match(plain)
    if found:
        return ("alias", found[1], "using", found[2].strip(), []) if found[1] else ("alias", found[4], "typedef", found[3].strip(), [])
    opened = plain.find("(")
    equals = plain.find("=")
    if opened > 0 and (equals < 0 or opened < equals or "operator" in plain[:opened]):
        named = re.search(r"((?:[A-Za-z_]\w*::)*(?:~?[A-Za-z_]\w*|operator\s*[^\s(]+))\s*(?:(?<!operator)<[\w\s:,*&<>]*>\s*)?$", plain[:opened])
        stop = closing(plain, opened)
        if named and stop > 0 and _TAIL.match(plain[stop + 1 :]):
            name = named[1].replace(" ", "")
            before = plain[: named.start()].strip()
            short = name.split("::")
            special = short[-1].lstrip("~") in (short[-2] if len(short) > 1 else None, owner)
            bare = " ".join(_QUALIFIER.sub(" ", before).split())
            params = [parameter(p) for p in split_top(plain[opened + 1 : stop]) if p != "void"]
            values = plain[-1] == ";" and any(re.match(r"[-+]?\d|[\"'&]|(?:true|false|nullptr|NULL)$", t) for t, _ in params)
            if short[-1] not in CONTROL and (bare or special) and not re.search(r"(?:^|\s)(?:return|else|typedef|using|goto|case)$|[=.]|->", before) and not values:
                return "function", name, "definition" if plain[-1] == "{" else "declaration", bare or None, params
    found = _VARIABLE.match(plain)
    if found and found[1].split()[0] not in NO_TYPE | {"using", "typedef", "friend", "namespace"}:
        kind = " ".join(_QUALIFIER.sub(" ", found[1]).split())
        if kind and not re.fullmatch(r"(?:class|struct|enum|union)", kind):
            return "variable", found[2], "variable", kind, []
    return None


def inner_variables(text: str) -> list[tuple[str, str]]:
    """(type, name) of variables that blocks within a statement's brackets declare, as the bodies of lambdas do."""
    if "{" not in text[:-1] or "(" not in text:
        return []
    inner = (head_of(part, None) for part in re.split(r"(?<=[{};])", text)[1:] if part.strip())
    return [(h[3], h[1]) for h in inner if h and h[0] == "variable"]


#: Statements whose heads a worker remembers, and how long they may be; the same members stand in many files.
REMEMBERED, SHORT = 8192, 512


@lru_cache(maxsize=1)
def _calls_udf():
    kind = pa.list_(pa.struct([("skip", pa.int32()), ("kind", pa.string()), ("receiver", pa.string()), ("name", pa.string()), ("argc", pa.int32()), ("args", pa.list_(pa.string()))]))

    @F.arrow_udf("array<struct<skip:int,kind:string,receiver:string,name:string,argc:int,args:array<string>>>")
    def run(text: pa.Array, initialisers: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), initialisers.to_pylist(), strict=True)
        return pa.array([[(a, k, r, n, len(x), x) for a, k, r, n, x in calls_of(t, bool(i))] if t else [] for t, i in rows], kind)

    return run


def _read(text: str, owner: str | None) -> tuple:
    return *(head_of(text, owner) or (None, None, None, None, [])), inner_variables(text)


@lru_cache(maxsize=REMEMBERED)
def _read_once(text: str, owner: str | None) -> tuple:
    return _read(text, owner)


@lru_cache(maxsize=1)
def _head_udf():
    pairs = pa.list_(pa.struct([("type", pa.string()), ("name", pa.string())]))
    kind = pa.struct([("what", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("type", pa.string()), ("params", pairs), ("inner", pairs)])

    @F.arrow_udf("struct<what:string,name:string,kind:string,type:string,params:array<struct<type:string,name:string>>,inner:array<struct<type:string,name:string>>>")
    def run(text: pa.Array, owner: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), owner.to_pylist(), strict=True)
        return pa.array([None if t is None else _read_once(t, o) if len(t) <= SHORT else _read(t, o) for t, o in rows], kind)

    return run


def calls(text: Column, initialisers: Column | None = None) -> Column:
    """array of struct(skip, kind, receiver, name, argc, args) of the calls in a statement; see ``calls_of``. None of null."""
    return _calls_udf()(text, F.lit(False) if initialisers is None else initialisers)


def declared(text: Column, owner: Column) -> Column:
    """struct(what, name, kind, type, params, inner) of what a statement declares; all null if nothing, null of null.

    ``inner``: ``inner_variables``.
    """
    return _head_udf()(text, owner)
