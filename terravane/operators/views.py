"""Graph views: nodes with a category and a layer, capped for drawing, and their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NODES = 200
#: The layer of a role in the architecture view.
ROLE_LAYERS = {"ENDPOINT": 0, "SOURCE": 0, "controller": 1, "service": 2, "mapper-interface": 3, "validator": 3, "repository": 4, "TABLE": 5, "SINK": 5, "STATE": 5}


def capped_graph(nodes: DataFrame, edges: DataFrame, most: int = MAX_NODES) -> DataFrame:
    """nodes: id, layer. The distinct edges among the `most` nodes with the smallest ids (the cap is the drawing's)."""
    kept = nodes.orderBy("id").limit(most)
    a = F.broadcast(kept.select(F.col("id").alias("_a"), F.col("layer").alias("from_layer")))
    b = F.broadcast(kept.select(F.col("id").alias("_b"), F.col("layer").alias("to_layer")))
    e = edges.select("from_id", "to_id").join(a, F.col("from_id") == F.col("_a")).join(b, F.col("to_id") == F.col("_b"))
    return e.select("from_id", "to_id", "from_layer", "to_layer").distinct()


def architecture_nodes(entities: DataFrame) -> DataFrame:
    """Entities with a role in the architecture: id, label, category, layer."""
    role = (
        F.when(F.col("kind") == "ENDPOINT", "ENDPOINT")
        .when(F.col("kind") == "DATA_SOURCE", "SOURCE")
        .when(F.col("kind") == "DATA_SINK", "SINK")
        .when(F.col("kind") == "DATABASE_OBJECT", "TABLE")
        .when((F.col("kind") == "VARIABLE") & (F.col("language") == "ada"), "STATE")
        .otherwise(F.element_at("attrs", "role"))
    )
    layer = F.element_at(F.create_map(*(F.lit(x) for kv in ROLE_LAYERS.items() for x in kv)), F.col("category"))
    shown = F.when(F.col("kind").isin("ENDPOINT", "DATABASE_OBJECT"), F.col("name")).otherwise(F.col("qualified_name"))
    e = entities.select("id", shown.alias("label"), role.alias("category")).where(F.col("category").isNotNull() & ~F.col("category").startswith("dto"))
    return e.withColumn("layer", F.coalesce(layer, F.lit(2)))
