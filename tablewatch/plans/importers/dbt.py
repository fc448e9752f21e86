"""Models, sources and lineage from a table of dbt manifest documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# The manifest fields that are read.
NODE = (
    "STRUCT<name: STRING, resource_type: STRING, database: STRING, schema: STRING, alias: STRING, "
    "columns: MAP<STRING, STRUCT<name: STRING>>, tags: ARRAY<STRING>, "
    "depends_on: STRUCT<nodes: ARRAY<STRING>>>"
)
MANIFEST = f"""
nodes MAP<STRING, {NODE}>,
sources MAP<STRING, STRUCT<
  name STRING, source_name STRING, database STRING, schema STRING,
  columns MAP<STRING, STRUCT<name STRING>>,
  freshness STRUCT<warn_after STRUCT<count BIGINT, period STRING>>>>,
child_map MAP<STRING, ARRAY<STRING>>,
parent_map MAP<STRING, ARRAY<STRING>>
"""
# The fields that edges read: what is not asked for is skipped, not built.
DEPENDENCIES = "nodes MAP<STRING, STRUCT<name: STRING, resource_type: STRING, depends_on: STRUCT<nodes: ARRAY<STRING>>>>"


def _parse(manifests: DataFrame, text: str, fields: str = MANIFEST) -> DataFrame:
    return manifests.select("manifest_id", F.from_json(F.col(text), fields).alias("m"))


def _nodes(parsed: DataFrame) -> DataFrame:
    return parsed.select("manifest_id", F.explode("m.nodes").alias("key", "node"))


def _column_names(columns: Column) -> Column:
    return F.coalesce(F.sort_array(F.map_keys(columns)), F.array().cast("array<string>"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _references(field: str, side: str) -> Column:
    """References of all nodes: (other, owner, side, pos)."""
    pairs = F.coalesce(F.map_entries(f"m.{field}"), F.array().cast("array<struct<key:string,value:array<string>>>"))

    def of_owner(entry: Column) -> Column:
        return F.transform(
            entry["value"],
            lambda other, i: F.struct(
                other.alias("key"), F.lit(None).cast(NODE).alias("node"), entry["key"].alias("owner"),
                F.lit(side).alias("side"), i.alias("pos"),
            ),
        )

    return F.flatten(F.transform(pairs, of_owner))


def models(manifests: DataFrame, text: str = "manifest") -> DataFrame:
    """One row per model: name, place, columns, tags, upstream and downstream models.

    A document is parsed once, into nodes and references to nodes. References learn the
    name of their node on the node's key, then meet their owner.
    """
    none = F.lit(None).cast("string")
    nodes = F.transform(
        F.map_entries("m.nodes"),
        lambda e: F.struct(
            e["key"].alias("key"), e["value"].cast(NODE).alias("node"), none.alias("owner"), none.alias("side"),
            F.lit(None).cast("int").alias("pos"),
        ),
    )
    rows = _parse(manifests, text).select(
        "manifest_id", F.inline(F.concat(nodes, _references("parent_map", "up"), _references("child_map", "down")))
    )
    # Rows of one node: itself and what refers to it.
    node = Window.partitionBy("manifest_id", "key")
    named = rows.withColumn("other_name", F.max("node.name").over(node)).where(
        "node.resource_type = 'model' OR (owner IS NOT NULL AND other_name IS NOT NULL)"
    )
    listed = lambda side: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "other_name")))),
        lambda x: x["other_name"],
    )
    grouped = named.groupBy("manifest_id", F.coalesce("owner", "key").alias("key")).agg(
        F.max_by("node", F.col("node").isNotNull()).alias("node"), listed("up").alias("up"), listed("down").alias("down")
    )
    empty = F.array().cast("array<string>")
    return grouped.where("node IS NOT NULL").select(
        "manifest_id",
        F.col("node.name").alias("name"),
        _text("node.database").alias("database"),
        _text("node.schema").alias("schema"),
        _text("node.alias").alias("alias"),
        _column_names(F.col("node.columns")).alias("columns"),
        F.col("up").alias("upstream_models"),
        F.col("down").alias("downstream_models"),
        F.coalesce("node.tags", empty).alias("tags"),
    )


def sources(manifests: DataFrame, text: str = "manifest") -> DataFrame:
    """One row per source, with its freshness warning as text (``6 hours``)."""
    listed = _parse(manifests, text).select("manifest_id", F.explode("m.sources").alias("key", "s"))
    warn = F.col("s.freshness.warn_after")
    warning = F.concat_ws(
        " ",
        F.coalesce(warn["count"], F.lit(0)).cast("string"),
        F.coalesce(warn["period"], F.lit("hours")),
    )
    return listed.select(
        "manifest_id",
        F.col("s.name").alias("name"),
        _text("s.source_name").alias("source_name"),
        _text("s.database").alias("database"),
        _text("s.schema").alias("schema"),
        _column_names(F.col("s.columns")).alias("columns"),
        F.when(warn.isNotNull(), warning).alias("freshness_warn"),
    )


def edges(manifests: DataFrame, text: str = "manifest") -> DataFrame:
    """Rows (manifest_id, parent, child, kind) from ``depends_on``; an unknown parent keeps its key."""
    names = F.struct(F.col("key"), F.col("node.name").alias("name"), F.lit(None).cast("string").alias("child"))
    wanted = F.transform(
        F.when(F.col("node.resource_type") == "model", F.col("node.depends_on.nodes")),
        lambda other: F.struct(
            other.alias("key"), F.lit(None).cast("string").alias("name"), F.col("node.name").alias("child")
        ),
    )
    empty = F.array().cast("array<struct<key:string,name:string,child:string>>")
    rows = _nodes(_parse(manifests, text, DEPENDENCIES)).select(
        "manifest_id", F.inline(F.concat(F.array(names), F.coalesce(wanted, empty)))
    )
    node = Window.partitionBy("manifest_id", "key")
    return (
        rows.withColumn("parent", F.coalesce(F.max("name").over(node), F.col("key")))
        .where("child IS NOT NULL")
        .select("manifest_id", "parent", "child", F.lit("dbt_model").alias("kind"))
    )
