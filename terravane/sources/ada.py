"""Ada and SPARK facts: the source is cut into tokens, declarations and statements are read from them, and a stack of
open units says whose they are. Package state, calls and contracts stay symbolic; the lineage rules decide what they
mean."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..model import stable_id
from .facts import Extractor, Facts, at, extension, place

VERSION = "1.2.0"
#: Fixed values.
KEYWORDS = frozenset(
    "abort abs abstract accept access aliased all and array at begin body case constant declare delay delta digits do else elsif end entry exception exit for function generic goto if in interface is limited "
    "loop mod new not null of or others out overriding package pragma private procedure protected raise range record rem renames requeue return reverse select separate some subtype synchronized tagged task "
    "terminate then type until use when while with xor".split()
)
MODES = ("in", "out", "aliased", "constant")
DECISIONS = ("if", "elsif", "when", "loop")
#: Words and marks behind which a new statement may begin.
OPENERS = frozenset("then loop is declare else select do record generic private exception =>".split())
SCAN = re.compile(r"""--[^\n]* | (?P<text>"(?:[^"\n]|"")*"?) | (?P<char>(?<![\w)])'[^\n]') | (?P<word>[^\W\d]\w*) | (?P<number>\d[\w.#]*) | (?P<mark>:=|=>|\.\.|\S)""", re.X)


@dataclass(frozen=True)
class Tok:
    kind: str
    text: str
    low: str
    line: int
    pos: int


def tokens(source: str) -> list[Tok]:
    """Words, numbers, literals and marks with their lines; comments are left out."""
    out, line, counted = [], 1, 0
    for m in SCAN.finditer(source):
        if m.lastgroup:
            line += source.count("\n", counted, m.start())
            counted = m.start()
            out.append(Tok(m.lastgroup, m[0], m[0].lower() if m.lastgroup == "word" else m[0], line, m.start()))
    return out


@dataclass
class Heading:
    """A subprogram's heading: parameter types in order, names, return type, contracts."""

    types: list[str] = field(default_factory=list)
    names: set[str] = field(default_factory=set)
    returns: str | None = None
    contracts: dict[str, str] = field(default_factory=dict)

    @property
    def profile(self) -> str:
        return f"({','.join(self.types)})" if self.types else ""


@dataclass
class Unit:
    """An open package or subprogram body."""

    kind: str
    name: str
    qn: str
    id: str
    line: int
    part: str
    head: Heading | None = None
    exposed: bool = True
    complexity: int = 1
    running: bool = False  # its begin has been met
    hidden: set[str] = field(default_factory=set)
    touched: set[tuple[str, str]] = field(default_factory=set)


class Reader:
    def __init__(self, path: str, content: str, content_hash: str):
        self.out = Facts(path, "ada", f"ada/{VERSION}")
        self.file = self.out.file(content_hash)
        self.in_body = extension(path) == "adb"
        self.source, self.t = content, tokens(content)
        self.lines = content.count("\n") + 1
        self.open: list[Unit] = []
        self.state: dict[str, str] = {}

    # The token list

    def low(self, i: int) -> str:
        return self.t[i].low if 0 <= i < len(self.t) else ""

    def word(self, i: int) -> bool:
        return i < len(self.t) and self.t[i].kind == "word"

    def name(self, i: int) -> tuple[str, int]:
        """The dotted name that begins at i, and where it ends."""
        if not self.word(i):
            return "", i
        parts, i = [self.t[i].text], i + 1
        while self.low(i) == "." and self.word(i + 1):
            parts.append(self.t[i + 1].text)
            i += 2
        return ".".join(parts), i

    def until(self, i: int, stops) -> int:
        """The first of the stops from i on that stands outside brackets, or the end."""
        depth = 0
        while i < len(self.t):
            x = self.low(i)
            if depth == 0 and x in stops:
                return i
            depth += (x == "(") - (x == ")")
            i += 1
        return i

    def written(self, a: int, b: int) -> str:
        """The text of tokens a to b, white space squeezed; what string literals hold is not looked at."""
        if a >= b:
            return ""
        raw = list(self.source[self.t[a].pos : self.t[b - 1].pos + len(self.t[b - 1].text)])
        for x in self.t[a:b]:
            if x.kind == "text":
                s = x.pos - self.t[a].pos
                raw[s + 1 : s + len(x.text) - 1] = " " * max(0, len(x.text) - 2)
        return " ".join(re.sub(r"--[^\n]*", "", "".join(raw)).split())

    def here(self, i: int) -> dict:
        return place(self.out.path, self.t[i].line, self.t[i].line)

    # The open units

    def top(self) -> Unit | None:
        return self.open[-1] if self.open else None

    def routine(self) -> Unit | None:
        return next((u for u in reversed(self.open) if u.head), None)

    def part(self, part: str, loc: dict) -> dict:
        return {"adaPart": part, "hasSpec": part == "spec", "hasBody": part == "body", f"{part}Location": at(loc)}

    def leaf(self, kind: str, name: str, loc: dict, profile: str = "", **attrs) -> str:
        """An entity inside the innermost open unit, or inside the file."""
        u = self.top()
        id_ = self.out.entity(kind, name, (f"{u.qn}." if u else "") + name + profile, loc, **attrs)
        self.out.contains(u.id if u else self.file, id_)
        return id_

    def enter(self, unit: Unit) -> None:
        u = self.top()
        self.out.contains(u.id if u else self.file, unit.id)
        self.open.append(unit)

    def leave(self, end: int) -> None:
        u = self.open.pop()
        loc = place(self.out.path, u.line, end)
        more = {"cyclomaticComplexity": u.complexity, **self.described(u.head)} if u.head else {}
        self.out.entity(u.kind, u.name, u.qn, loc, loc=end - u.line + 1, externallyExposed=u.exposed, **self.part(u.part, loc), **more)

    def described(self, h: Heading) -> dict:
        pre, post = h.contracts.get("pre"), h.contracts.get("post")
        return {"paramTypes": ",".join(h.types) or None, "returnType": h.returns, "sparkPrecondition": pre, "sparkPostcondition": post, "languageFeature": "spark-contract" if pre or post else None}

    # Reading

    def read(self) -> Facts:
        i = 0
        while i < len(self.t):
            i = max(i + 1, self.sentence(i))
        while self.open:
            self.leave(self.lines)
        return self.out

    def sentence(self, i: int) -> int:
        """One declaration or statement from i on; gives where the next one begins."""
        x = self.low(i)
        if x in ("overriding", "not", "private", "generic", "limited") and self.low(i + 1) in ("overriding", "procedure", "function", "package", "with", "type"):
            return i + 1
        if x == "begin":
            if u := self.top():
                u.running = True
            return i + 1
        if x == "end":
            return self.ended(i)
        if x == "with" and self.word(i + 1) and self.low(i + 1) not in KEYWORDS:
            return self.context(i)
        if x in ("package", "procedure", "function"):
            return self.unit(i)
        if x in ("type", "subtype"):
            return self.type(i)
        if x in ("task", "protected"):
            n = i + 1 + (self.low(i + 1) in ("type", "body"))
            if self.word(n):
                self.leaf("TASK" if x == "task" else "PROTECTED_TYPE", self.t[n].text, self.here(i))
            return self.until(n, ("is", ";")) + 1
        if self.word(i) and self.low(i + 1) in (",", ":"):
            return self.declared(i)
        return self.statement(i, i)

    def ended(self, i: int) -> int:
        name, j = self.name(i + 1)
        u = self.top()
        if u and self.low(j) == ";" and name.lower() == u.name.lower().strip('"'):
            self.leave(self.t[i].line)
        elif u and self.low(i + 1) in KEYWORDS:  # end if, end loop and the like
            return self.until(i, (";",)) + 1
        return j + (self.low(j) == ";")

    def context(self, i: int) -> int:
        stop = self.until(i, (";",))
        j = i + 1
        while j < stop:
            name, j = self.name(j)
            if not name or self.low(j) not in (",", ";"):
                break
            self.out.edge("IMPORTS", self.file, name, self.here(i), typeName=name)
            j += 1
        return stop + 1

    def unit(self, i: int) -> int:
        """A package or subprogram: an instance of a generic, a body, or a declaration."""
        kind, j = self.low(i), i + 1
        j += kind == "package" and self.low(j) == "body"
        quoted = j < len(self.t) and self.t[j].kind == "text"  # an operator's name
        name, j = ('"' + " " * (len(self.t[j].text) - 2) + '"', j + 1) if quoted else self.name(j)
        if not name:
            return i + 1
        loc = self.here(i)
        if self.low(j) == "is" and self.low(j + 1) == "new":
            generic, j = self.name(j + 2)
            self.out.edge("INSTANTIATES", self.leaf(kind.upper(), name, loc), generic, typeName=generic)
            return self.until(j, (";",)) + 1
        if kind == "package":
            stop = self.until(j, ("is", ";", "renames"))
            if self.low(stop) == "is":
                u = self.top()
                qn = f"{u.qn}.{name}" if u and not u.head else name
                self.enter(Unit("PACKAGE", name, qn, stable_id("ada", "PACKAGE", qn), loc["s_line"], "body" if self.in_body else "spec"))
                return stop + 1
            return self.statement(stop, i)
        head, j = self.heading(j)
        if self.low(j) == "renames":
            j = self.statement(j, i) - 1
        u = self.top()
        qn = (f"{u.qn}." if u else "") + name + head.profile
        if self.in_body and self.low(j) == "is" and self.low(j + 1) not in ("abstract", "null", "separate", "(", "new"):
            self.enter(Unit(kind.upper(), name, qn, stable_id("ada", kind.upper(), qn), loc["s_line"], "body", head, exposed=False, hidden=set(head.names)))
            return j + 1
        self.leaf(kind.upper(), name, loc, head.profile, externallyExposed=u is None or u.head is None, **self.part("spec", loc), **self.described(head))
        return self.until(j, (";",)) + 1

    def heading(self, j: int) -> tuple[Heading, int]:
        """Parameters, result and contracts from j on; stops at is, at renames or at the semicolon."""
        h = Heading()
        if self.low(j) == "(":
            j += 1
            while j < len(self.t) and self.low(j) != ")":
                colon = self.until(j, (":", ";", ")"))
                own = [x.low for x in self.t[j:colon] if x.kind == "word"]
                stop = self.until(colon, (";", ")"))
                if self.low(colon) == ":":
                    a, b = colon + 1, min(self.until(colon + 1, (":=",)), stop)
                    while b - a > 1 and self.low(a) in MODES:
                        a += 1
                    h.names |= set(own)
                    h.types += [self.written(a, b)] * len(own)
                j = stop + (self.low(stop) == ";")
            j += 1
        if self.low(j) == "return":
            j += 1
            while self.low(j) in ("not", "null", "access", "constant"):
                j += 1
            h.returns, j = self.name(j)
        stops = ("is", "renames", ";")
        j = self.until(j, ("with", *stops))
        if self.low(j) == "with":
            j = self.aspects(j + 1, h, stops)
        elif self.low(j) == "is" and self.low(j + 1) in ("abstract", "null", "("):  # aspects may follow these too
            if self.low(k := self.until(j + 1, ("with", ";"))) == "with":
                self.aspects(k + 1, h, (";",))
        return h, j

    def aspects(self, j: int, h: Heading, stops) -> int:
        while True:
            end = self.until(j, (",", *stops))
            if self.word(j) and self.low(j) in ("pre", "post") and self.low(j + 1) == "=>":
                h.contracts.setdefault(self.low(j), self.written(j + 2, end))
            if self.low(end) != ",":
                return end
            j = end + 1

    def type(self, i: int) -> int:
        if not self.word(i + 1):
            return i + 1
        start = self.until(i + 2, ("is", ";"))
        if self.low(start) != "is":
            return start + 1
        stop = self.until(start, (";",))
        words = [x.low for x in self.t[start + 1 : stop]]
        feature = "record" if "record" in words else "enumeration" if words[:1] == ["("] else "access" if "access" in words else "derived" if "new" in words else "type"
        self.leaf("TYPE", self.t[i + 1].text, self.here(i), languageFeature=feature, externallyExposed=not self.in_body)
        if "record" in words and words[max(0, words.index("record") - 1)] != "null":  # the components are the type's own
            while stop < len(self.t) and not (self.low(stop) == "end" and self.low(stop + 1) == "record"):
                stop += 1
            stop = self.until(stop, (";",))
        return stop + 1

    def declared(self, i: int) -> int:
        """Names, a colon and a type; else a statement that begins with a name."""
        names, j = [self.t[i].text], i + 1
        while self.low(j) == "," and self.word(j + 1):
            names.append(self.t[j + 1].text)
            j += 2
        if self.low(j) != ":":
            return self.statement(i, i)
        if self.low(j + 1) == "exception":
            self.leaf("EXCEPTION", names[0], self.here(i))
            return self.until(j, (";",)) + 1
        constant = self.low(j + 1) == "constant"
        kind, after = self.name(j + 1 + constant)
        u = self.top()
        if u is None or u.running or not kind or kind.lower() in KEYWORDS:
            return self.statement(i, i)
        loc = self.here(i)
        for n in names:
            if u.head:
                u.hidden.add(n.lower())
                continue
            self.leaf("VARIABLE", n, loc, variableType=kind, externallyExposed=not self.in_body, constant=True if constant else None, **self.part("body" if self.in_body else "spec", loc))
            self.state[n.lower()] = n
        return self.statement(j + 1 + constant, i, touches=False)

    def statement(self, i: int, first: int, touches: bool = True) -> int:
        """What the tokens from i to the end of the statement do: decisions, writes, reads, renamings, calls."""
        stop = self.until(i, OPENERS | {";"})
        u, r = self.top(), self.routine()
        if r:
            r.complexity += sum(self.t[k].low in DECISIONS or (self.t[k].low, self.low(k + 1)) in (("and", "then"), ("or", "else")) for k in range(i, min(stop + 1, len(self.t))))
        if self.low(stop) == "else" and self.low(stop - 1) == "or" or self.low(stop) == "then" and self.low(stop - 1) == "and":  # a condition goes on
            self.used(i, stop, u, r, touches, whole=False)
            return self.statement(stop + 1, first, touches)
        self.used(i, stop, u, r, touches, whole=i == first and self.low(stop) == ";")
        return stop + 1

    def names(self, i: int, stop: int) -> Iterator[tuple[str, int, int]]:
        while i < stop:
            full, j = self.name(i)
            if full:
                yield full, i, j
            i = max(i + 1, j)

    def used(self, i: int, stop: int, u: Unit | None, r: Unit | None, touches: bool, whole: bool) -> None:
        if u is None:
            return
        start = i
        if touches and u.running:
            target, j = self.name(i)
            if target and self.low(j) == ":=":
                self.touch("WRITES_TO", target, self.here(i))
                start = j + 1
            for full, a, b in self.names(start, stop):
                if "." not in full and full.lower() in self.state and self.low(a - 1) != ".":
                    self.touch("READS_FROM", self.state[full.lower()], self.here(a))
                elif "." in full and self.low(b) != "(":
                    self.touch("READS_FROM", full, self.here(a))
        found = list(self.names(i, stop))
        for k, (full, a, b) in enumerate(found):
            if full.lower() == "renames" and k + 1 < len(found):
                self.out.edge("RENAMES", u.id, found[k + 1][0], typeName=found[k + 1][0])
            alone = whole and len(found) == 1 and a == i and b == stop
            simple = full.rsplit(".", 1)[-1]
            if r and (alone or self.low(b) == "(") and simple.lower() not in KEYWORDS and simple.lower() != r.name.lower():
                self.out.edge("CALLS", r.id, simple, self.here(a), callName=simple, qualifiedCallName=full if "." in full else None)

    def touch(self, kind: str, target: str, loc: dict) -> None:
        u, r = self.top(), self.routine()
        mark = (kind, target.lower())
        if (r and target.split(".")[0].lower() in r.hidden) or mark in u.touched:
            return
        u.touched.add(mark)
        package = next((x.qn for x in reversed(self.open) if not x.head), "")
        self.out.edge(kind, u.id, target, loc, stateName=target, enclosingPackage=package)


def extract(path: str, content: str, content_hash: str) -> Facts:
    return Reader(path, content, content_hash).read()


EXTRACTOR = Extractor("ada", VERSION, lambda p: extension(p) in ("ads", "adb", "ada"), extract)
