"""What an extractor returns for one file, and the registry that picks the extractor."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..model import stable_id


def place(file: str, s: int = 0, e: int = 0, sc: int = 0, ec: int = 0) -> dict:
    return {"file": file, "s_line": s, "e_line": e, "s_col": sc, "e_col": ec}


def at(loc: dict | None) -> str:
    """file:line, or file."""
    return "" if loc is None else f"{loc['file']}:{loc['s_line']}" if loc["s_line"] > 0 else loc["file"]


def text(v) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


@dataclass
class Facts:
    path: str
    language: str
    analyzer: str = ""
    entities: list[dict] = field(default_factory=list)
    relationships: list[dict] = field(default_factory=list)
    issues: list[tuple[str, str, int]] = field(default_factory=list)

    def entity(self, kind: str, name: str, qualified: str, where: dict | None = None, **attrs) -> str:
        id_ = stable_id(self.language, kind, qualified)
        self.entities.append({"id": id_, "kind": kind, "name": name, "qualified_name": qualified, "language": self.language, "loc": where, "attrs": {k: text(v) for k, v in attrs.items() if v is not None}})
        return id_

    def edge(self, kind: str, from_id: str, to_id: str, where: dict | None = None, resolved: bool = False, status: str | None = None, **attrs) -> None:
        status = status or ("UNRESOLVED" if not resolved else "DISCOVERED" if kind == "CONTAINS" else "RESOLVED")
        self.relationships.append({"from_id": from_id, "to_id": to_id, "kind": kind, "resolved": resolved, "status": status, "loc": where, "attrs": {k: text(v) for k, v in attrs.items() if v is not None}})

    def contains(self, owner: str, member: str) -> None:
        self.edge("CONTAINS", owner, member, resolved=True)

    def file(self, content_hash: str | None = None) -> str:
        return self.entity("FILE", self.path.rsplit("/", 1)[-1], self.path, place(self.path), fileHash=content_hash)

    def error(self, message: str, line: int = 0) -> None:
        self.issues.append(("ERROR", message, line))

    def warn(self, message: str, line: int = 0) -> None:
        self.issues.append(("WARNING", message, line))


@dataclass(frozen=True)
class Extractor:
    id: str
    version: str
    supports: Callable[[str], bool]  # by path alone
    extract: Callable[[str, str, str], Facts]  # path, content, hash


def registry() -> list[Extractor]:
    """First fitting one wins; build files before configuration. Add to the list to plug in another language."""
    from . import ada, build, config, ddl, java

    return [java.EXTRACTOR, ada.EXTRACTOR, ddl.EXTRACTOR, build.EXTRACTOR, config.EXTRACTOR]


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    dot = name.rfind(".")
    return name[dot + 1 :] if dot > 0 else ""
