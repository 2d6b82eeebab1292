"""Java facts by a token scanner: declarations are followed by brace matching, bodies are token ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .facts import Extractor, Facts, extension, place

VERSION = "1.1.0"
#: Fixed values.
EXPOSING = frozenset(
    "Test BeforeEach AfterEach BeforeAll AfterAll ParameterizedTest GetMapping PostMapping PutMapping DeleteMapping PatchMapping RequestMapping Bean Component Service Repository "
    "Controller RestController Configuration Autowired Inject EventListener Scheduled PostConstruct PreDestroy Entity Override WebMethod".split()
)
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE"}
WRAPPERS = frozenset("ResponseEntity Optional List Set Collection Iterable".split())
REPOSITORIES = frozenset("JpaRepository CrudRepository ListCrudRepository PagingAndSortingRepository ListPagingAndSortingRepository".split())
ROLES = (("RestController", "controller"), ("Controller", "controller"), ("Service", "service"), ("Repository", "repository"), ("Mapper", "mapper-interface"))
PRIMITIVES = frozenset("void boolean byte short int long char float double var".split())
PARAMETERS = {"PathVariable": "path", "RequestParam": "query", "RequestHeader": "header"}
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())
KEYWORDS = frozenset("if for while do switch case default catch try finally return throw new super this assert synchronized else instanceof yield break continue".split())
TYPE_WORDS = ("class", "interface", "enum", "record")
TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|(?P<block>"""(?:[^\\]|\\.)*?""")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<chr>\'(?:[^\'\\\n]|\\.)+\')|(?P<id>[^\W\d][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>->|::|&&|\|\||\.\.\.|[^\s\w])', re.DOTALL)
ESCAPE = re.compile(r'\\(u+[0-9a-fA-F]{4}|[0-7]{1,3}|.)', re.DOTALL)
SIMPLE_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "s": " "}
SQL_WORD = re.compile(r"""[\w."`]+""")
SQL_START = re.compile(r"^\s*(SELECT|INSERT|UPDATE|DELETE|MERGE|WITH)\b", re.IGNORECASE)


class Malformed(Exception):
    pass


@dataclass(slots=True)
class Tok:
    kind: str
    text: str
    line: int
    col: int
    end: int


def lex(source: str) -> list[Tok]:
    out, pos, line, start = [], 0, 1, 0
    for m in TOKEN.finditer(source):
        a, z = m.span()
        if a != pos:  # a character that begins no token was passed over
            break
        kind, text, pos = m.lastgroup, m[0], z
        if kind == "id" or kind == "num":
            out.append(Tok(kind, text, line, a - start + 1, line))
            continue
        if kind == "op":
            if text == "/" and source.startswith("*", z):
                raise Malformed(f"unreadable text at line {line}")
            if text in "\"'":
                raise Malformed(f"unclosed literal at line {line}")
            out.append(Tok(kind, text, line, a - start + 1, line))
            continue
        n = text.count("\n")  # spaces, comments and literals may hold line ends
        if kind:
            out.append(Tok(kind, text, line, a - start + 1, line + n))
        if n:
            line, start = line + n, a + text.rfind("\n") + 1
    if pos < len(source):
        raise Malformed(f"unreadable text at line {line}")
    return out


def literal(t: Tok) -> str:
    body = t.text[3:-3] if t.kind == "block" else t.text[1:-1]

    def one(m):
        c = m[1]
        return chr(int(c.lstrip("u"), 16)) if c[0] == "u" else chr(int(c, 8)) if c[0].isdigit() else SIMPLE_ESCAPES.get(c, c)

    return ESCAPE.sub(one, body)


def sql_access(sql: str, reads: set[str], writes: set[str]) -> None:
    """Tables of one literal, by a walk over its words: a word that introduces a table says whether it is read or written.
    The column form is functions.text.sql_tables."""
    from ..functions.text import SQL_INTO, SQL_STOP

    words = SQL_WORD.findall(sql)
    verb = words[0].upper()
    before = ""
    for word, name in zip(words, words[1:]):
        word = word.upper()
        into, two = SQL_INTO[verb].get(word), SQL_INTO[verb].get(f"{before} {word}")
        before = word
        table = name.replace('"', "").replace("`", "").rsplit(".", 1)[-1].lower()
        if (use := two or into) and table and table not in SQL_STOP:
            (writes if use == "write" else reads).add(table)
    reads -= writes


@dataclass
class Mods:
    words: set[str] = field(default_factory=set)
    annotations: dict[str, list[Tok]] = field(default_factory=dict)
    first: Tok | None = None

    def visibility(self) -> str:
        return next((v for v in ("public", "protected", "private") if v in self.words), "package")


class Scanner:
    def __init__(self, path: str, source: str, content_hash: str):
        self.t = lex(source)
        self.i = 0
        self.out = Facts(path, "java", f"java/{VERSION}")
        self.file = self.out.file(content_hash)
        self.pairs = self.match()
        self.package = ""

    # -- tokens

    def match(self) -> dict[int, int]:
        stack, pairs = [], {}
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in "([{":
                stack.append(i)
            elif t.kind == "op" and t.text in ")]}":
                if not stack or self.t[stack[-1]].text + t.text not in ("()", "[]", "{}"):
                    raise Malformed(f"unbalanced '{t.text}' at line {t.line}")
                pairs[stack.pop()] = i
        if stack:
            raise Malformed(f"unclosed '{self.t[stack[-1]].text}' at line {self.t[stack[-1]].line}")
        return pairs

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k].kind if self.i + k < len(self.t) else ""

    def angle(self, i: int) -> int:
        """Index after the type arguments that open at i."""
        depth = 0
        while i < len(self.t):
            x = self.t[i].text
            depth += (x == "<") - (x == ">")
            i += 1
            if depth == 0:
                return i
            if x in ("{", ";"):
                break
        raise Malformed("unclosed type arguments")

    def name(self) -> str:
        parts = [self.peek()]
        self.i += 1
        while self.peek() == "." and self.kind(1) == "id":
            parts.append(self.peek(1))
            self.i += 2
        return ".".join(parts)

    def spell(self, a: int, b: int) -> str:
        out = ""
        for t in self.t[a:b]:
            if t.text == ",":
                out += ", "
            elif out and (out[-1].isalnum() or out[-1] in "?_") and (t.kind == "id"):
                out += " " + t.text
            else:
                out += t.text
        return out

    def type(self) -> str:
        """A type's text; annotations within are skipped."""
        a = self.i
        while self.peek() == "@":
            self.annotation(Mods())
            a = self.i
        if self.kind() != "id":
            raise Malformed(f"type expected at line {self.t[min(self.i, len(self.t) - 1)].line if self.t else 0}")
        while True:
            self.name()
            if self.peek() == "<":
                self.i = self.angle(self.i)
            if self.peek() == "." and self.kind(1) == "id":
                self.i += 1
                continue
            break
        while self.peek() == "[" and self.peek(1) == "]":
            self.i += 2
        return self.spell(a, self.i)

    def annotation(self, mods: Mods) -> None:
        self.i += 1
        name = self.name().rsplit(".", 1)[-1]
        args: list[Tok] = []
        if self.peek() == "(":
            z = self.pairs[self.i]
            args, self.i = self.t[self.i + 1 : z], z + 1
        mods.annotations[name] = args

    def modifiers(self) -> Mods:
        m = Mods(first=self.t[self.i] if self.i < len(self.t) else None)
        while self.i < len(self.t):
            if self.peek() == "@" and self.peek(1) != "interface":
                self.annotation(m)
            elif self.peek() == "non" and self.peek(1) == "-":
                self.i += 3
            elif self.peek() in MODIFIERS and not (self.peek() == "default" and self.peek(1) in (":", "->")):
                m.words.add(self.peek())
                self.i += 1
            else:
                break
        return m

    # -- declarations

    def run(self) -> Facts:
        types, imports, package = [], [], None
        while self.i < len(self.t):
            if self.peek() == ";":
                self.i += 1
                continue
            m = self.modifiers()
            word = self.peek()
            if word == "package":
                self.i += 1
                self.package = self.name()
                package = self.out.entity("PACKAGE", self.package.rsplit(".", 1)[-1], self.package)
                self.i += 1
            elif word == "import":
                self.i += 1 + (self.peek(1) == "static")
                imports.append(self.name())
                while self.i < len(self.t) and self.peek() != ";":
                    self.i += 1
                self.i += 1
            elif self.is_type():
                types.append(self.type_declaration(m, self.package))
            else:
                raise Malformed(f"declaration expected at line {self.t[self.i].line if self.i < len(self.t) else 0}")
        for t in types:
            self.out.contains(self.file, t)
            if package:
                self.out.contains(package, t)
        for i in imports:
            self.out.edge("IMPORTS", self.file, i, typeName=i)
        return self.out

    def is_type(self) -> bool:
        return self.peek() == "@" or (self.peek() in TYPE_WORDS and self.kind(1) == "id" and not (self.peek() == "record" and self.peek(2) not in ("(", "<")))

    def type_list(self) -> list[str]:
        out = [self.type()]
        while self.peek() == ",":
            self.i += 1
            out.append(self.type())
        return out

    def type_declaration(self, m: Mods, outer: str) -> str:
        first = m.first
        word = "interface" if self.peek() == "@" else self.peek()
        kind = "ANNOTATION" if self.peek() == "@" else {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD"}[word]
        self.i += 2 if kind == "ANNOTATION" else 1
        name = self.peek()
        self.i += 1
        if self.peek() == "<":
            self.i = self.angle(self.i)
        if kind == "RECORD":
            self.i = self.pairs[self.i] + 1
        lists: dict[str, list[str]] = {}
        while self.peek() in ("extends", "implements", "permits"):
            w = self.peek()
            self.i += 1
            lists[w] = self.type_list()
        if self.peek() != "{":
            raise Malformed(f"body of {name} expected")
        open_, close = self.i, self.pairs[self.i]
        qn = f"{outer}.{name}" if outer else name
        loc = place(self.out.path, first.line, self.t[close].line, first.col, self.t[close].col)
        has = m.annotations
        role = next((r for a, r in ROLES if a in has), None)
        attrs: dict = {"visibility": m.visibility(), "externallyExposed": "public" in m.words or bool(EXPOSING & has.keys()), "loc": loc["e_line"] - loc["s_line"] + 1}
        if kind == "INTERFACE":
            for e in lists.get("extends", []):
                if e.split("<")[0].rsplit(".", 1)[-1] in REPOSITORIES:
                    role = "repository"
                    attrs["springDataRepository"] = True
                    attrs["managedEntityType"] = _arguments(e)[0] if _arguments(e) else None
                    break
        attrs["role"] = role
        if "Entity" in has:
            attrs["jpaEntity"] = True
            value = _member(has.get("Table", []), "name")
            if value and len(value) == 1 and value[0].kind == "str":
                attrs["jpaTableName"] = literal(value[0])
        id_ = self.out.entity(kind, name, qn, loc, **attrs)
        if kind in ("CLASS", "INTERFACE"):
            for w, rel in (("extends", "INHERITS"), ("implements", "IMPLEMENTS")):
                for e in lists.get(w, []):
                    scope = e.split("<")[0]
                    self.out.edge(rel, id_, scope.rsplit(".", 1)[-1], typeName=scope)
        self.i = open_ + 1
        if kind == "ENUM":
            while self.i < close and self.peek() != ";":
                self.i = self.pairs.get(self.i, self.i) + 1
            self.i += self.i < close
        base = _path(has.get("RequestMapping"))
        while self.i < close:
            self.member(id_, kind, name, qn, base, close)
        self.i = close + 1
        return id_

    def member(self, owner: str, owner_kind: str, owner_name: str, qn: str, base, close: int) -> None:
        if self.peek() == ";":
            self.i += 1
            return
        m = self.modifiers()
        if self.peek() == "{":
            self.i = self.pairs[self.i] + 1
            return
        if self.i >= close:
            return
        if self.is_type():
            self.out.contains(owner, self.type_declaration(m, qn))
            return
        if self.peek() == "<":
            self.i = self.angle(self.i)
        if self.peek() == owner_name and self.peek(1) in ("(", "{"):
            self.i += 1
            self.callable(m, "CONSTRUCTOR", owner_name, None, owner, owner_kind, qn, base)
            return
        type_ = self.type()
        name = self.peek()
        if self.kind() != "id":
            raise Malformed(f"name expected at line {self.t[self.i].line}")
        if self.peek(1) == "(":
            self.i += 1
            self.callable(m, "METHOD", name, type_, owner, owner_kind, qn, base)
            return
        names = []
        start = m.first
        while True:
            name, own = self.peek(), type_
            self.i += 1
            while self.peek() == "[":
                self.i = self.pairs[self.i] + 1
                own += "[]"
            names.append((name, own))
            while self.i < close and self.peek() not in (",", ";"):
                self.i = self.angle_or_next()
            if self.peek() == "," and self.kind(1) == "id":
                self.i += 1
                continue
            break
        end = self.t[min(self.i, len(self.t) - 1)]
        self.i += 1
        for name, own in names:
            f = self.out.entity("FIELD", name, f"{qn}#{name}", place(self.out.path, start.line, end.line, start.col, end.col), visibility=m.visibility(), fieldType=own)
            self.out.contains(owner, f)
            self.reference(owner, own)

    def angle_or_next(self) -> int:
        """Past a bracket pair, past the type arguments of `new X<A, B>`, or one token on."""
        if self.i in self.pairs:
            return self.pairs[self.i] + 1
        if self.peek() == "<" and self.t[self.i - 1].kind == "id" and self.t[self.i - 1].text[:1].isupper():
            try:
                return self.angle(self.i)
            except Malformed:
                pass
        return self.i + 1

    def reference(self, owner: str, type_text: str) -> None:
        base = type_text.split("<")[0].replace("[]", "").replace("...", "").strip()
        if base and base not in PRIMITIVES:
            self.out.edge("REFERENCES", owner, base.rsplit(".", 1)[-1], typeName=base)

    def parameters(self) -> list[tuple[str, str, dict]]:
        """(type, name, annotations) of the list that opens here."""
        z, out = self.pairs[self.i], []
        self.i += 1
        while self.i < z:
            m = self.modifiers()
            type_ = self.type()
            if self.peek() == "...":
                type_ += "..."
                self.i += 1
            name = self.peek()
            self.i += 1
            if name == "this" or self.peek() == ".":  # a receiver parameter is none
                while self.i < z and self.peek() != ",":
                    self.i += 1
                name = ""
            while self.peek() == "[" and self.i < z:
                type_ += "[]"
                self.i += 2
            if name:
                out.append((type_, name, m.annotations))
            self.i += 1
        self.i = z + 1
        return out

    def callable(self, m: Mods, kind: str, name: str, returns: str | None, owner: str, owner_kind: str, qn: str, base) -> None:
        ps = self.parameters() if self.peek() == "(" else []
        while self.i < len(self.t) and self.peek() not in ("{", ";"):
            self.i = self.pairs.get(self.i, self.i) + 1
        body = (self.i + 1, self.pairs[self.i]) if self.peek() == "{" else (self.i, self.i)
        end = self.t[body[1]]
        self.i = body[1] + 1
        types = ",".join(re.sub(r"\s+", "", t) for t, _, _ in ps)
        signature = f"{name}({types})"
        loc = place(self.out.path, m.first.line, end.line, m.first.col, end.col)
        main = kind == "METHOD" and name == "main" and {"public", "static"} <= m.words
        reads, writes, dynamic = self.sql(*body)
        normal = unwrap(returns) if returns else None
        id_ = self.out.entity(
            kind, name, f"{qn}#{signature}", loc, signature=signature, visibility=m.visibility(),
            externallyExposed="public" in m.words or bool(EXPOSING & m.annotations.keys()) or main or owner_kind == "INTERFACE",
            cyclomaticComplexity=self.complexity(*body), loc=loc["e_line"] - loc["s_line"] + 1, paramTypes=types or None, returnType=returns,
            returnTypeNormalized=normal if normal != "void" else None, nativeMethod=True if "native" in m.words else None,
            sqlReads=",".join(sorted(reads)) or None, sqlWrites=",".join(sorted(writes)) or None, sqlDynamic=True if dynamic else None,
        )
        self.out.contains(owner, id_)
        for t in ([returns] if returns else []) + [t for t, _, _ in ps]:
            self.reference(owner, t)
        verb = next((a for a in m.annotations if a in VERBS), None)
        if kind == "METHOD" and verb:
            self.endpoint(m, verb, ps, normal, owner, id_, base, loc)
        self.calls(id_, *body)

    def endpoint(self, m: Mods, verb: str, ps, normal, owner: str, handler: str, base, loc) -> None:
        own = _path(m.annotations[verb])
        if base[1] or own[1]:
            path = "{unresolved:" + (base[0] or own[0]) + "}"
        else:
            path = re.sub(r"/{2,}", "/", f"/{base[0]}/{own[0]}")
            path = path[:-1] if len(path) > 1 and path.endswith("/") else path
        body = next((unwrap(t, ()) for t, _, a in ps if "RequestBody" in a), None)
        params = ",".join(f"{n}:{PARAMETERS[a]}" for _, n, an in ps for a in PARAMETERS if a in an)
        valid = "Validated" in m.annotations or any({"Valid", "Validated"} & a.keys() for _, _, a in ps)
        e = self.out.entity(
            "ENDPOINT", f"{VERBS[verb]} {path}", f"{VERBS[verb]}:{path}", loc, httpMethod=VERBS[verb], httpPath=path, externallyExposed=True, httpPathUnresolved=True if base[1] or own[1] else None,
            requestBodyType=body, returnTypeNormalized=normal if normal != "void" else None, httpParams=params or None, validated=True if valid else None,
        )
        rule = {"ruleId": "ENDPOINT-001", "ruleVersion": "1", "analyzerId": self.out.analyzer, "confidence": "1.00"}
        self.out.edge("EXPOSES", owner, e, loc, True, "DISCOVERED", **rule)
        self.out.edge("INVOKES", e, handler, loc, True, "DISCOVERED", **rule)

    # -- bodies

    def complexity(self, a: int, z: int) -> int:
        n, i = 1, a
        while i < z:
            x, t = self.t[i].text, self.t[i]
            if t.kind == "id" and x in ("if", "for", "while", "catch"):
                n += 1
            elif x in ("&&", "||"):
                n += 1
            elif x == "?" and self.t[i - 1].text not in ("<", ",") and self.t[i + 1].text not in (">", "extends", "super"):
                n += 1
            elif t.kind == "id" and x == "case":
                labels, j = 1, i + 1
                while j < z and self.t[j].text not in (":", "->"):
                    labels += self.t[j].text == ","
                    j = self.pairs.get(j, j) + 1
                n += labels
            elif t.kind == "id" and x == "default" and self.t[i + 1].text in (":", "->"):
                n += 1
            i += 1
        return n

    def sql(self, a: int, z: int) -> tuple[set[str], set[str], bool]:
        reads, writes, dynamic = set(), set(), False
        for i in range(a, z):
            if self.t[i].kind == "str" and SQL_START.match(s := literal(self.t[i])):
                sql_access(s, reads, writes)
                dynamic |= "+" in (self.t[i - 1].text, self.t[i + 1].text)
        return reads, writes, dynamic

    def arguments(self, open_: int) -> int:
        z, i, n = self.pairs[open_], open_ + 1, 1
        if i == z:
            return 0
        while i < z:
            if self.t[i].text == ",":
                n += 1
            if i in self.pairs:
                i = self.pairs[i]
            elif self.t[i].text == "<" and self.t[i - 1].kind == "id" and self.t[i - 1].text[:1].isupper():
                try:
                    j = self.angle(i)
                    i = j - 1 if j <= z else i
                except Malformed:
                    pass
            i += 1
        return n

    def calls(self, caller: str, a: int, z: int) -> None:
        i, made = a, []
        while i < z:
            t = self.t[i]
            before = self.t[i - 1]
            if t.kind == "id" and t.text == "new" and self.t[i + 1].kind == "id":
                j, parts = i + 1, []
                while j < z and self.t[j].kind == "id":
                    parts.append(self.t[j].text)
                    j += 1
                    if self.t[j].text == "<":
                        j = self.angle(j)
                    if self.t[j].text != ".":
                        break
                    j += 1
                if self.t[j].text == "(":
                    made.append((parts[-1], ".".join(parts)))
                i = j
                continue
            if t.kind == "id" and self.t[i + 1].text == "(" and t.text not in KEYWORDS and before.text != "@":
                declared = (before.kind == "id" and before.text not in KEYWORDS) or before.text in ("]", ">")
                after = self.t[self.pairs[i + 1] + 1].text if self.pairs[i + 1] + 1 < len(self.t) else ""
                if not (declared and (after in ("{", "throws") or before.kind == "id")):
                    self.out.edge("CALLS", caller, t.text, place(self.out.path, t.line, self.t[self.pairs[i + 1]].line, t.col, self.t[self.pairs[i + 1]].col), callName=t.text, argCount=self.arguments(i + 1), receiverName=self.receiver(i))
            i += 1
        for simple, scoped in made:
            self.out.edge("INSTANTIATES", caller, simple, typeName=scoped)

    def receiver(self, i: int) -> str | None:
        """x of x.m() and of this.x.m(); none for chained and implicit receivers."""
        if self.t[i - 1].text != "." or self.t[i - 2].kind != "id" or self.t[i - 2].text in ("this", "super"):
            return None
        x = self.t[i - 2].text
        if self.t[i - 3].text != ".":
            return x
        return x if self.t[i - 4].text == "this" and self.t[i - 5].text != "." else None


def _arguments(type_text: str) -> list[str]:
    if "<" not in type_text or not type_text.endswith(">"):
        return []
    out, depth, cur = [], 0, ""
    for c in type_text[type_text.index("<") + 1 : -1]:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()] if cur.strip() else out


def unwrap(type_text: str, wrappers=WRAPPERS) -> str:
    """The simple name of a type, response wrappers with one argument taken off."""
    t = type_text
    while t.split("<")[0].rsplit(".", 1)[-1] in wrappers and len(a := _arguments(t)) == 1:
        t = a[0]
    return re.sub(r"\s+", "", t).split("<")[0].replace("[]", "").replace("...", "").rsplit(".", 1)[-1]


def _member(args: list[Tok], name: str) -> list[Tok] | None:
    for i, t in enumerate(args):
        if t.text == name and i + 1 < len(args) and args[i + 1].text == "=":
            j, depth = i + 2, 0
            while j < len(args) and not (args[j].text == "," and depth == 0):
                depth += (args[j].text in "([{") - (args[j].text in ")]}")
                j += 1
            return args[i + 2 : j]
    return None


def _path(args: list[Tok] | None) -> tuple[str, bool]:
    """(path, unresolved) of a mapping annotation."""
    if not args:
        return "", False
    value = _member(args, "value") or _member(args, "path")
    if value is None:
        if any(t.text == "=" for t in args):
            return "", False
        value = args
    if len(value) == 1 and value[0].kind in ("str", "block"):
        return literal(value[0]), False
    return "".join(t.text for t in value), True


def extract(path: str, content: str, content_hash: str) -> Facts:
    try:
        return Scanner(path, content, content_hash).run()
    except (Malformed, IndexError, KeyError, RecursionError) as e:
        out = Facts(path, "java")
        out.error(f"Java parse failed: {e}")
        return out


EXTRACTOR = Extractor("java", VERSION, lambda p: extension(p) == "java", extract)
