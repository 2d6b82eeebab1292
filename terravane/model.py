"""The data model: two tables, entities and relationships, with fixed vocabularies, stable ids and merge rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOC = T.StructType([T.StructField("file", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("s_line", "e_line", "s_col", "e_col"))])
ATTRS = T.MapType(T.StringType(), T.StringType())
ENTITIES = T.StructType([*(T.StructField(c, T.StringType()) for c in ("id", "kind", "name", "qualified_name", "language")), T.StructField("loc", LOC), T.StructField("attrs", ATTRS)])
RELATIONSHIPS = T.StructType([T.StructField("ord", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("from_id", "to_id", "kind")), T.StructField("resolved", T.BooleanType()), T.StructField("status", T.StringType()), T.StructField("loc", LOC), T.StructField("attrs", ATTRS)])

#: The vocabularies.
ENTITY_KINDS = tuple("PROJECT MODULE FILE PACKAGE NAMESPACE CLASS INTERFACE ENUM RECORD TYPE PROTECTED_TYPE GENERIC METHOD CONSTRUCTOR FUNCTION PROCEDURE TASK FIELD VARIABLE ANNOTATION EXCEPTION CONFIGURATION DATABASE_OBJECT WORKFLOW ENDPOINT DEPENDENCY DATA_SOURCE DATA_SINK".split())
RELATIONSHIP_KINDS = tuple("CONTAINS CALLS REFERENCES INHERITS IMPLEMENTS IMPORTS DEPENDS_ON DECLARES_MAIN CONFIGURES USES MAPS_TO PERSISTS_TO GENERATES INSTANTIATES RENAMES THROWS EXPOSES INVOKES CONSUMES PRODUCES READS_FROM WRITES_TO VALIDATED_BY MANAGES".split())
STATUSES = ("DISCOVERED", "RESOLVED", "INFERRED", "UNRESOLVED")
AGGREGATING = ("FILE", "PROJECT", "PACKAGE", "NAMESPACE", "DATABASE_OBJECT")
CALLABLES = ("METHOD", "CONSTRUCTOR", "FUNCTION", "PROCEDURE")
LINK_TYPES = ("CLASS", "INTERFACE", "ENUM", "RECORD", "TYPE")
PROJECT_TYPES = ("CLASS", "INTERFACE", "ENUM", "RECORD")

#: What counts as usage differs by question; these sets are four on purpose.
COUPLING_USAGE = tuple("CALLS REFERENCES INHERITS IMPLEMENTS INSTANTIATES USES DEPENDS_ON INVOKES".split())
DEAD_USAGE = tuple("CALLS REFERENCES INHERITS IMPLEMENTS INSTANTIATES USES IMPORTS RENAMES DEPENDS_ON INVOKES CONSUMES PRODUCES VALIDATED_BY MANAGES CONFIGURES DECLARES_MAIN".split())
TOOL_USAGE = tuple("CALLS INVOKES REFERENCES INHERITS IMPLEMENTS INSTANTIATES USES IMPORTS DEPENDS_ON CONSUMES PRODUCES READS_FROM WRITES_TO MAPS_TO PERSISTS_TO VALIDATED_BY MANAGES RENAMES DECLARES_MAIN".split())
GRAPH_USAGE = tuple("CALLS INVOKES REFERENCES INHERITS IMPLEMENTS INSTANTIATES USES CONSUMES PRODUCES READS_FROM WRITES_TO MAPS_TO PERSISTS_TO MANAGES CONFIGURES".split())
LINEAGE_KINDS = tuple("INVOKES CONSUMES PRODUCES READS_FROM WRITES_TO MAPS_TO PERSISTS_TO VALIDATED_BY MANAGES USES".split())
CALL_KINDS, DB_KINDS = ("CALLS", "INVOKES"), ("MAPS_TO", "PERSISTS_TO", "READS_FROM", "WRITES_TO", "USES")
DEAD_CANDIDATES = tuple("CLASS ENUM RECORD METHOD FUNCTION PROCEDURE FIELD TYPE".split())

#: The token of a kind in an id; kinds not listed use their name in lower case.
TOKENS = {"CLASS": "type", "INTERFACE": "type", "ENUM": "type", "RECORD": "type", "TYPE": "type", "PROTECTED_TYPE": "type", "ANNOTATION": "type", "DATABASE_OBJECT": "table", "DATA_SOURCE": "source", "DATA_SINK": "sink"}


def stable_id(language: str | None, kind: str, qualified_name: str) -> str:
    """file:<path>, project:<name>, config:<path>, else <language>:<token>:<qualified name>."""
    if kind in ("FILE", "PROJECT"):
        return f"{kind.lower()}:{qualified_name}"
    if kind == "CONFIGURATION":
        return f"config:{qualified_name}"
    lang = (language or "").strip().lower()
    return f"{'code' if lang in ('', 'unknown', 'n/a') else lang}:{TOKENS.get(kind, kind.lower())}:{qualified_name}"


def stable_id_column(language: Column, kind: Column, qualified_name: Column) -> Column:
    """stable_id() over columns."""
    token = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TOKENS.items() for x in kv)), kind), F.lower(kind))
    lang = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    lang = F.when(lang.isin("", "unknown", "n/a"), F.lit("code")).otherwise(lang)
    return (
        F.when(kind.isin("FILE", "PROJECT"), F.concat_ws(":", F.lower(kind), qualified_name))
        .when(kind == "CONFIGURATION", F.concat(F.lit("config:"), qualified_name))
        .otherwise(F.concat_ws(":", lang, token, qualified_name))
    )


def attr(key: str) -> Column:
    """An attribute of either table; null where absent."""
    return F.element_at("attrs", key)


def int_attr(key: str, default: int) -> Column:
    """On-demand typed reading: the default where absent or not a number."""
    return F.coalesce(attr(key).try_cast("int"), F.lit(default))


def bool_attr(key: str) -> Column:
    return F.coalesce(F.lower(attr(key)) == "true", F.lit(False))


def confidence() -> Column:
    """Edge confidence, kept as text with two decimals; 1.0 where absent or malformed."""
    return F.coalesce(attr("confidence").try_cast("double"), F.lit(1.0))


def render(loc: Column) -> Column:
    """file:line, or file where the line is unknown; null without a location."""
    return F.when(loc["s_line"] > 0, F.concat_ws(":", loc["file"], loc["s_line"].cast("string"))).otherwise(loc["file"])


def line_span(loc: Column) -> Column:
    known = (loc["s_line"] > 0) & (loc["e_line"] > 0)
    return F.coalesce(F.when(known, F.greatest(F.lit(0), loc["e_line"] - loc["s_line"] + 1)), F.lit(0))


def default_status(kind: Column, resolved: Column) -> Column:
    return F.when(~resolved, "UNRESOLVED").when(kind == "CONTAINS", "DISCOVERED").otherwise("RESOLVED")


def last_segment(c: Column, mark: str = ".") -> Column:
    return F.substring_index(c, mark, -1)
