"""Catalogue nesting and collection snapshots.

A snapshot is written as one JSON item per row (collection, kind, name,
item), partitioned by collection, instead of one document string per
collection: a collection holding a third of all items is then many rows and
files, never one value in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.functions.jsonx import TO_JSON_OPTS
from tierline.functions.text import strip_tenant_schemas
from tierline.operators.governance import redact_secrets
from tierline.operators import merge
from tierline.operators.joins import lookup_join

FIELD_LIST = "array<struct<ordinal:int,name:string,data_type:string>>"


def nest_fields(entities: DataFrame, fields: DataFrame, layer: str | None = None) -> DataFrame:
    """J8 each entity with its fields as an ordinal-ordered JSON list.
    Fields are grouped per entity first (bounded by the entity's columns),
    then joined to the header rows."""
    ents = entities if layer is None else entities.filter(F.col("layer") == layer)
    f = fields.groupBy("entity_id").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("ordinal", "name", "data_type"))), TO_JSON_OPTS)
        .alias("fields"))
    return ents.join(f, ents.id == f.entity_id, "left").drop("entity_id")


def snapshot_items(entities_nested: DataFrame, transforms: DataFrame, connectors: DataFrame) -> DataFrame:
    """S19 items of every collection: entities with ordered fields,
    transforms with tenant prefixes stripped, connectors with secrets
    redacted and the target entity's name resolved (equi join on id)."""
    e = entities_nested.filter(F.col("collection").isNotNull()).select(
        "collection", F.lit("entity").alias("kind"), "name",
        F.to_json(F.struct("name", "layer", "description",
                           F.from_json(F.coalesce("fields", F.lit("[]")), FIELD_LIST).alias("fields")),
                  TO_JSON_OPTS).alias("item"))
    t = transforms.filter(F.col("collection").isNotNull()).select(
        "collection", F.lit("transform").alias("kind"), "name",
        F.to_json(F.struct("name", "source_layer", "target_layer",
                           strip_tenant_schemas(F.col("transform_sql")).alias("transform_sql"),
                           "trigger_mode"), TO_JSON_OPTS).alias("item"))
    names = entities_nested.select(F.col("id").alias("target_entity_id"), F.col("name").alias("entity_name"))
    c = lookup_join(connectors.filter(F.col("collection").isNotNull()), names, "target_entity_id", "left")
    c = c.select("collection", F.lit("connector").alias("kind"), "name",
                 F.to_json(F.struct("name", "connector_type", redact_secrets("config").alias("config"),
                                    "entity_name"), TO_JSON_OPTS).alias("item"))
    return e.unionByName(t).unionByName(c)


def import_items(items: DataFrame, existing: DataFrame, overwrite: bool) -> DataFrame:
    """S20 outcome per imported item against the target tenant's items (by
    natural key kind + name): created when absent, else updated when
    ``overwrite`` else skipped."""
    ex = existing.select("kind", "name", F.lit(True).alias("_exists")).distinct()
    j = items.join(ex, ["kind", "name"], "left")
    outcome = F.when(F.col("_exists").isNull(), "created").when(F.lit(overwrite), "updated").otherwise("skipped")
    return j.select("collection", "kind", "name", outcome.alias("outcome"), "item")


def import_merge(items: DataFrame, existing: DataFrame, overwrite: bool) -> DataFrame:
    """S20 the target tenant's items after the import: one per natural key
    (kind, name).  With ``overwrite`` imported items replace existing ones,
    without it only new ones are added; of imported items with one key the
    last by collection counts."""
    keys = ["kind", "name"]
    held = existing.select("collection", *keys, "item")
    new = items.select("collection", *keys, "item")
    change = merge.upsert if overwrite else merge.insert_ignore
    return change(held, merge.keep_latest(new, keys, ["collection", "item"]), keys)
