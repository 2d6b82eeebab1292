"""The query API over a snapshot or a model: 21 operations that return an envelope with rows, a total and a note."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import CALL_KINDS, TOOL_USAGE, attr, bool_attr, render
from .operators import analysis as an
from .operators import graph as gr
from .operators import neighbors as nb
from .sources.store import Store

DEFAULT_LIMIT = 50


@dataclass
class Result:
    """What an operation returns. total is -1 where it does not apply."""

    scan_id: str
    value: object
    truncated: bool = False
    total: int = -1
    note: str = ""
    supported: bool = True

    def to_json(self) -> str:
        return json.dumps({"scanId": self.scan_id, "supported": self.supported, "value": self.value, "truncated": self.truncated, "totalMatches": self.total, "note": self.note}, sort_keys=True, default=str)


def records(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


@dataclass
class Api:
    spark: SparkSession
    entities: DataFrame
    relationships: DataFrame
    files: DataFrame
    diagnostics: DataFrame
    scan_id: str
    _memo: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Api:
        """Read-only, over the latest completed scan."""
        s = Store(spark, path, read_only=True)
        now = s.current()
        return cls(spark, s.table("entities"), s.table("relationships"), s.table("files"), s.table("diagnostics"), now["scan_id"])

    @classmethod
    def of(cls, model) -> Api:
        return cls(model.entities.sparkSession, model.entities, model.relationships, model.files, model.diagnostics, model.scan_id)

    # -- envelopes

    def limited(self, df: DataFrame, limit: int, *order) -> Result:
        """The first rows in order and how many there are; limit 0 or less means the default."""
        most = limit if limit > 0 else DEFAULT_LIMIT
        total = df.count()
        return Result(self.scan_id, records(df.orderBy(*order).limit(most)), total > most, total)

    def missing(self, id_: str) -> Result:
        return Result(self.scan_id, [], False, 0, f"no entity with stable id '{id_}'")

    def has(self, id_: str) -> bool:
        return not self.entities.where(F.col("id") == id_).isEmpty()

    # -- entities

    def find_entity(self, shorthand: str) -> Result:
        rows = records(nb.find(self.entities, shorthand).orderBy("id").limit(11))
        if len(rows) == 1:
            return Result(self.scan_id, rows[0], False, 1)
        note = "nothing matches" if not rows else "ambiguous; candidates: " + ", ".join(r["id"] for r in rows[:10])
        return Result(self.scan_id, None, len(rows) > 10, len(rows), note)

    def get_entity(self, id_: str) -> Result:
        rows = records(self.entities.where(F.col("id") == id_))
        return Result(self.scan_id, rows[0] if rows else None, False, len(rows))

    def search_entities(self, text: str, kind: str | None = None, language: str | None = None, limit: int = 0) -> Result:
        return self.limited(nb.search(self.entities, text, kind, language), limit, "id")

    def get_source_evidence(self, id_: str) -> Result:
        rows = records(nb.evidence(self.entities, id_))
        return Result(self.scan_id, rows[0], note="locations and hashes; source text is not kept") if rows else self.missing(id_)

    # -- neighbours

    def _near(self, id_: str, kinds, incoming: bool, limit: int) -> Result:
        if not self.has(id_):
            return self.missing(id_)
        return self.limited(nb.neighbors(self.entities, self.relationships, id_, kinds, incoming), limit, "edge_kind", "other_id")

    def get_callers(self, id_: str, limit: int = 0) -> Result:
        return self._near(id_, CALL_KINDS, True, limit)

    def get_callees(self, id_: str, limit: int = 0) -> Result:
        return self._near(id_, CALL_KINDS, False, limit)

    def get_dependents(self, id_: str, limit: int = 0) -> Result:
        return self._near(id_, TOOL_USAGE, True, limit)

    def get_dependencies(self, id_: str, limit: int = 0) -> Result:
        return self._near(id_, TOOL_USAGE, False, limit)

    def get_members(self, id_: str, limit: int = 0) -> Result:
        return self._near(id_, ("CONTAINS",), False, limit)

    def _kind(self, kind: str) -> Result:
        rows = records(nb.view(self.entities.where(F.col("kind") == kind)).orderBy("id"))
        return Result(self.scan_id, rows, False, len(rows))

    def get_data_sources(self) -> Result:
        return self._kind("DATA_SOURCE")

    def get_data_sinks(self) -> Result:
        return self._kind("DATA_SINK")

    def get_database_references(self, id_: str | None = None, limit: int = 0) -> Result:
        return self.limited(nb.database_references(self.entities, self.relationships, id_), limit, "kind", "from_id", "to_id")

    # -- lineage and impact

    def trace_data_lineage(self, id_: str, direction: str = "down", depth: int = gr.DEPTH, floor: float = gr.FLOOR, inferred: bool = True) -> Result:
        t = gr.trace(self.entities, self.relationships, id_, direction, depth, floor, inferred)
        value = {"start": id_, "direction": direction, "nodes": t.nodes, "paths": records(t.paths.orderBy("no")), "gaps": records(t.gaps.orderBy("kind", "from_id", "to_id")), "cycles": t.cycles}
        return Result(self.scan_id, value, t.truncated, len(value["paths"]))

    def calculate_change_impact(self, id_: str, depth: int = 5, limit: int = 0) -> Result:
        if not self.has(id_):
            return self.missing(id_)
        most = limit if limit > 0 else DEFAULT_LIMIT
        direct = self.get_dependents(id_, most)
        seeds = self.spark.createDataFrame([(r["other_id"],) for r in direct.value], "id string")
        far = gr.dependents(self.relationships, id_, seeds, depth)
        indirect = self.limited(far.join(nb.view(self.entities), "id"), most, "id")
        data = self.limited(nb.co_touch(self.relationships, id_), most, "from_id", "to_id", "kind")
        lineage = self.trace_data_lineage(id_).value["nodes"]
        name = self.get_entity(id_).value["name"]
        risks = records(nb.risk_references(self.relationships, name).orderBy("from_id").limit(most))
        value = {"id": id_, "direct": direct.value, "indirect": indirect.value, "database": data.value, "lineage": [x for x in lineage if x != id_][:most], "risks": risks}
        return Result(self.scan_id, value, indirect.truncated or data.truncated, note="reflection, wiring and dynamic paths may add impact that is not seen here")

    # -- analyses, computed once a session

    def dead(self) -> DataFrame:
        if "dead" not in self._memo:
            self._memo["dead"] = an.dead_code(self.entities, self.relationships)
        return self._memo["dead"]

    def find_dead_code_candidates(self, limit: int = 0) -> Result:
        r = self.limited(self.dead(), limit, F.desc("confidence"), "qualified_name")
        r.note = "probable only; review before removal"
        return r

    def get_complexity(self, limit: int = 0, threshold: int = 10) -> Result:
        return self.limited(an.complexity_hotspots(self.entities, threshold), limit, F.desc("complexity"), "id")

    def get_repository_summary(self) -> Result:
        metrics = an.file_metrics(self.files).first().asDict()
        kinds = {r["kind"]: r["count"] for r in self.entities.groupBy("kind").count().orderBy("kind").collect()}
        languages = {r["language"]: r["count"] for r in self.files.groupBy("language").count().orderBy("language").collect()}
        names = lambda k: [r["name"] for r in self._kind(k).value]
        value = {**metrics, "entities": kinds, "languages": languages, "endpoints": names("ENDPOINT"), "tables": names("DATABASE_OBJECT"), "sources": names("DATA_SOURCE"), "sinks": names("DATA_SINK")}
        value |= {"dead": self.dead().count(), "hotspots": an.complexity_hotspots(self.entities).count(), "unresolved": self.relationships.where(~F.col("resolved")).count(), "diagnostics": self.diagnostics.count()}
        return Result(self.scan_id, value)

    def get_unresolved_references(self, limit: int = 0) -> Result:
        return self.limited(nb.unresolved_references(self.relationships), limit, "from_id", "target", "kind")

    def get_reference_counts(self) -> Result:
        return Result(self.scan_id, nb.reference_counts(self.relationships).first().asDict())

    def get_diagnostics(self) -> Result:
        rows = records(self.diagnostics.orderBy("code", "message"))
        return Result(self.scan_id, rows, False, len(rows))

    def get_build_membership(self, id_: str | None = None, limit: int = 0) -> Result:
        modules = self.entities.where("kind = 'MODULE'").select(F.col("id").alias("m"))
        if modules.isEmpty():
            return Result(self.scan_id, [], False, 0, "no build files were found, so nothing declares membership")
        e = self.relationships.where("kind = 'CONTAINS'").where(F.col("to_id").startswith("file:")).join(modules, F.col("from_id") == F.col("m"), "left_semi").select("from_id", "to_id")
        if id_ is not None:
            own = self.get_entity(id_).value
            if own is None:
                return self.missing(id_)
            file = id_ if own["kind"] == "FILE" else f"file:{own['loc']['file']}" if own["loc"] else None
            if file is None:
                return Result(self.scan_id, [], False, 0, f"'{id_}' has no source location")
            e = e.where(F.col("to_id") == file)
        return self.limited(e.distinct(), limit, "from_id", "to_id")

    def get_configuration_references(self, id_: str | None = None, limit: int = 0) -> Result:
        e = self.relationships.where("kind = 'CONFIGURES' AND resolved")
        if id_ is not None:
            e = e.where((F.col("from_id") == id_) | (F.col("to_id") == id_))
        return self.limited(e.select("from_id", "to_id", attr("configKey").alias("key"), render(F.col("loc")).alias("location")), limit, "from_id", "to_id")

    def exposed(self) -> DataFrame:
        return self.entities.where(bool_attr("externallyExposed"))


OPERATIONS = tuple(
    "find_entity get_entity search_entities get_source_evidence get_callers get_callees get_dependents get_dependencies get_members get_data_sources get_data_sinks get_database_references trace_data_lineage calculate_change_impact "
    "find_dead_code_candidates get_complexity get_repository_summary get_unresolved_references get_diagnostics get_build_membership get_configuration_references".split()
)
