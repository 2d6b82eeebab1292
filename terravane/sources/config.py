"""Configuration facts: class names that keys configure. Values of secret keys are counted and never looked at."""

from __future__ import annotations

import re
from xml.parsers import expat

from ..functions.text import SECRETS
from .build import is_build_file
from .facts import Extractor, Facts, extension, place

VERSION = "1.0.0"
DOTTED, SECRET = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*(?:\.[A-Za-z_][A-Za-z0-9_$]*)+"), re.compile(SECRETS)


def class_name(value: str) -> str | None:
    for m in DOTTED.finditer(value):
        *package, last = m[0].split(".")
        if last[:1].isupper() and any(p[:1].islower() for p in package):
            return m[0]
    return None


class Keys:
    def __init__(self, out: Facts, config_id: str):
        self.out, self.config, self.seen, self.masked = out, config_id, set(), 0

    def pair(self, key: str, value: str, line: int) -> None:
        if SECRET.search(key):
            self.masked += 1
        else:
            self.value(key, value, line)

    def value(self, key: str, value: str, line: int) -> None:
        name = class_name(value)
        if name and (name, key) not in self.seen:
            self.seen.add((name, key))
            self.out.edge("CONFIGURES", self.config, name, place(self.out.path, line, line), typeName=name, configKey=key, analyzerId=self.out.analyzer)


def properties(text: str, keys: Keys) -> None:
    for no, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if line and line[0] not in "#!" and (m := re.search("[=:]", line)):
            keys.pair(line[: m.start()].strip(), line[m.end() :].strip(), no)


def yaml(text: str, keys: Keys) -> None:
    open_: list[tuple[int, str]] = []
    for no, raw in enumerate(text.split("\n"), 1):
        line = re.sub(r"""^((?:[^'"#]|'[^']*'|"[^"]*")*)#.*$""", r"\1", raw).rstrip()
        key, colon, value = line.strip().partition(":")
        if not colon or key.startswith("-"):
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        key, value = key.strip(), value.strip()
        if value:
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            keys.pair(".".join([*(k for _, k in open_), key]), value, no)
        else:
            open_.append((indent, key))


def safe_parser():
    """Expat that refuses document types, so nothing external or recursive can be pulled in."""
    p = expat.ParserCreate()

    def refuse(*_):
        raise ValueError("DOCTYPE is not allowed")

    p.StartDoctypeDeclHandler = refuse
    return p


def xml(text: str, keys: Keys) -> None:
    p, state = safe_parser(), {"element": "", "text": []}

    def start(name, attrs):
        state.update(element=name, text=[])
        for a, v in attrs.items():
            if SECRET.search(f"{name}.{a}"):
                keys.masked += 1
            else:
                keys.value(f"{name}@{a}", v, p.CurrentLineNumber)

    def end(name):
        body = "".join(state["text"]).strip()
        if body and name == state["element"]:
            keys.value(name, body, p.CurrentLineNumber)
        state["text"] = []

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, lambda s: state["text"].append(s)
    p.Parse(text, True)


READERS = {"properties": properties, "yaml": yaml, "yml": yaml, "xml": xml}


def extract(path: str, content: str, content_hash: str) -> Facts:
    out = Facts(path, "config", f"config/{VERSION}")
    ext = extension(path)
    id_ = f"config:{path}"
    keys = Keys(out, id_)
    try:
        READERS[ext](content, keys)
    except (expat.ExpatError, ValueError) as e:
        out.warn(f"configuration not parsed: {e}")
    out.entity("CONFIGURATION", path.rsplit("/", 1)[-1], path, place(path), format=ext, references=len(keys.seen), secretKeysMasked=keys.masked)
    out.contains(f"file:{path}", id_)
    return out


EXTRACTOR = Extractor("config", VERSION, lambda p: extension(p) in READERS and not is_build_file(p), extract)
