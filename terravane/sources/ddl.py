"""SQL schema facts: CREATE TABLE and VIEW, foreign keys inline, at table level and by ALTER TABLE."""

from __future__ import annotations

import re

from ..model import stable_id
from .facts import Extractor, Facts, extension, place

VERSION = "1.0.0"
NAME = r'([\w."`\[\]]+)'
CREATE = re.compile(rf"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:GLOBAL|LOCAL)\s+)?(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\((.*)\)", re.I | re.S)
VIEW = re.compile(rf"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s+AS\b", re.I | re.S)
NAMED = r'(?:CONSTRAINT\s+[\w."`\[\]]+\s+)?'
KEY = rf"FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+{NAME}"
ALTER = re.compile(rf"\bALTER\s+TABLE\s+(?:ONLY\s+)?{NAME}\s+ADD\s+{NAMED}{KEY}", re.I | re.S)
TABLE_KEY, TABLE_PRIMARY = re.compile(rf"^\s*{NAMED}{KEY}", re.I), re.compile(rf"^\s*{NAMED}PRIMARY\s+KEY\s*\(([^)]*)\)", re.I)
OTHER = re.compile(r"^\s*(CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK|INDEX|KEY|EXCLUDE)\b", re.I)
COLUMN, INLINE = re.compile(r'^\s*([\w"`\[\]]+)\s+(\w+(?:\s*\([^)]*\))?)'), re.compile(rf"\bREFERENCES\s+{NAME}", re.I)
COMMENTS = re.compile(r"/\*.*?(?:\*/|\Z)|--[^\n]*", re.S)


def simple(name: str) -> str:
    return re.sub(r'["`\[\]]', "", name.strip()).rsplit(".", 1)[-1].lower()


def split(body: str, mark: str) -> list[tuple[str, int]]:
    """Parts at marks outside parentheses, with their offsets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(body):
        depth = max(0, depth + (c == "(") - (c == ")"))
        if c == mark and depth == 0:
            out.append((body[start:i], start))
            start = i + 1
    return [p for p in [*out, (body[start:], start)] if p[0].strip()]


def extract(path: str, content: str, content_hash: str) -> Facts:
    out = Facts(path, "sql", f"sql/{VERSION}")
    sql = COMMENTS.sub(lambda m: "\n" * m[0].count("\n"), content)
    found = False
    for statement, start in split(sql, ";"):
        line = sql.count("\n", 0, start + len(statement) - len(statement.lstrip())) + 1
        loc = place(path, line, line)
        if m := CREATE.search(statement):
            found = True
            name = simple(m[1])
            columns, keys, primary = [], [], set()
            for item, _ in split(m[2], ","):
                if k := TABLE_KEY.search(item):
                    keys.append((simple(k[1].split(",")[0]), simple(k[2])))
                elif k := TABLE_PRIMARY.search(item):
                    primary |= {simple(c) for c in k[1].split(",")}
                elif not OTHER.search(item) and (k := COLUMN.search(item)):
                    upper = item.upper()
                    columns.append((simple(k[1]), re.sub(r"\s+", "", k[2]), "PRIMARY KEY" in upper, "NOT NULL" in upper))
                    if r := INLINE.search(item):
                        keys.append((columns[-1][0], simple(r[1])))
            table(out, name, m[1], "table", loc, columns, primary)
            for column, target in keys:
                foreign_key(out, name, column, target, loc)
        elif m := VIEW.search(statement):
            found = True
            table(out, simple(m[1]), m[1], "view", loc, [], set())
        elif m := ALTER.search(statement):
            found = True
            foreign_key(out, simple(m[1]), simple(m[2].split(",")[0]), simple(m[3]), loc)
    if not found:
        out.warn("no table, view or foreign key found; nothing recorded", 1)
    return out


def table(out: Facts, name: str, declared: str, kind: str, loc: dict, columns: list, primary: set[str]) -> None:
    id_ = out.entity("DATABASE_OBJECT", name, name, loc, dbObjectType=kind, externallyExposed=True, declaredIn=f"{loc['file']}:{loc['s_line']}", declaredName=re.sub(r'["`\[\]]', "", declared), columnCount=len(columns))
    out.contains(f"file:{loc['file']}", id_)
    for column, type_, key, not_null in columns:
        out.contains(id_, out.entity("FIELD", column, f"{name}.{column}", loc, sqlType=type_, primaryKey=key or column in primary, notNull=not_null, externallyExposed=True))


def foreign_key(out: Facts, owner: str, column: str, target: str, loc: dict) -> None:
    out.edge("REFERENCES", stable_id("sql", "DATABASE_OBJECT", owner), target, loc, False, "DISCOVERED", typeName=target, ruleId="SQL-FOREIGN-KEY-001", analyzerId=out.analyzer, confidence="1.00", foreignKeyColumn=column)


EXTRACTOR = Extractor("sql", VERSION, lambda p: extension(p) in ("sql", "ddl"), extract)
