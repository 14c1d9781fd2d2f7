"""Type schema: tables of types and properties, and validation against them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Property:
    name: str
    type: str = "string"
    required: bool = False
    least: float | None = None
    most: float | None = None
    allowed: tuple[str, ...] = ()
    pattern: str | None = None


@dataclass(frozen=True)
class EntityType:
    name: str
    properties: tuple[Property, ...] = ()
    required: tuple[str, ...] = ()
    parent: str | None = None


@dataclass(frozen=True)
class RelationshipType:
    name: str
    sources: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    properties: tuple[Property, ...] = ()


@dataclass
class Schema:
    entities: dict[str, EntityType] = field(default_factory=dict)
    relationships: dict[str, RelationshipType] = field(default_factory=dict)

    def add_entity_type(self, t: EntityType) -> None:
        if t.parent and t.parent not in self.entities:
            raise ValueError(f"no parent type {t.parent}")
        self.entities[t.name] = t

    def add_relationship_type(self, t: RelationshipType) -> None:
        for e in (*t.sources, *t.targets):
            if e not in self.entities:
                raise ValueError(f"no entity type {e}")
        self.relationships[t.name] = t

    def ancestors(self, name: str) -> list[str]:
        """The type and its parents, nearest first."""
        out: list[str] = []
        while name and name not in out and name in self.entities:
            out.append(name)
            name = self.entities[name].parent or ""
        return out

    def to_json(self) -> str:
        return json.dumps({"entities": [asdict(t) for t in self.entities.values()], "relationships": [asdict(t) for t in self.relationships.values()]})

    @classmethod
    def from_json(cls, text: str) -> Schema:
        raw, out = json.loads(text), cls()
        props = lambda t: tuple(Property(**{**p, "allowed": tuple(p["allowed"])}) for p in t["properties"])
        for t in raw["entities"]:
            out.entities[t["name"]] = EntityType(t["name"], props(t), tuple(t["required"]), t["parent"])
        for t in raw["relationships"]:
            out.relationships[t["name"]] = RelationshipType(t["name"], tuple(t["sources"]), tuple(t["targets"]), props(t))
        return out


def default_schema() -> Schema:
    s = Schema()
    s.add_entity_type(EntityType("person", (Property("full_name"), Property("age", "integer", least=0), Property("occupation"), Property("location")), ("full_name",)))
    s.add_entity_type(EntityType("organization", (Property("industry"), Property("size"), Property("founded_year", "integer"))))
    s.add_entity_type(EntityType("location", (Property("country"), Property("city"), Property("coordinates", "list"))))
    s.add_entity_type(EntityType("concept", (Property("domain"), Property("definition"))))
    s.add_relationship_type(RelationshipType("works_for", ("person",), ("organization",), (Property("position"), Property("start_date", "date"), Property("end_date", "date"))))
    s.add_relationship_type(RelationshipType("located_in", (), ("location",)))
    s.add_relationship_type(RelationshipType("related_to", (), (), (Property("relationship_strength", "float", least=0.0, most=1.0),)))
    return s


def value_fits(value: Column, p: Property) -> Column:
    """Whether a value given as text fits the property; null fits unless required."""
    ok = F.lit(True)
    number = F.expr("try_cast(_v as double)")
    if p.type == "integer":
        ok = ok & F.rlike(F.col("_v"), F.lit(r"^[+-]?\d+$"))
    elif p.type == "float":
        ok = ok & number.isNotNull()
    elif p.type == "boolean":
        ok = ok & F.lower("_v").isin("true", "false")
    elif p.type == "list":
        ok = ok & F.startswith(F.trim(F.col("_v")), F.lit("["))
    elif p.type == "dict":
        ok = ok & F.startswith(F.trim(F.col("_v")), F.lit("{"))
    if p.least is not None:
        ok = ok & (number >= p.least)
    if p.most is not None:
        ok = ok & (number <= p.most)
    if p.allowed:
        ok = ok & F.col("_v").isin(list(p.allowed))
    if p.pattern:
        ok = ok & F.rlike(F.col("_v"), F.lit(f"^(?:{p.pattern})"))
    return F.when(F.col("_v").isNull(), F.lit(not p.required)).otherwise(F.coalesce(ok, F.lit(False)))


def _property_errors(df: DataFrame, kind: str, types: Sequence[EntityType | RelationshipType]) -> DataFrame:
    """`df` with ``errors`` extended by what is missing or does not fit."""
    for t in types:
        own = F.col(kind) == t.name
        for name in getattr(t, "required", ()):
            missing = own & F.col("properties")[name].isNull()
            df = df.withColumn("errors", F.when(missing, F.array_append("errors", F.lit(f"Required property '{name}' missing"))).otherwise(F.col("errors")))
        for p in t.properties:
            df = df.withColumn("_v", F.col("properties")[p.name])
            bad = own & ~value_fits(F.col("_v"), p)
            df = df.withColumn("errors", F.when(bad, F.array_append("errors", F.lit(f"Property '{p.name}' validation failed"))).otherwise(F.col("errors")))
    return df.drop("_v")


def validate_entities(entities: DataFrame, schema: Schema) -> DataFrame:
    """`entities` with ``errors`` and ``valid``; an unknown type is the only error then."""
    known = F.col("entity_type").isin(list(schema.entities))
    none = F.array().cast("array<string>")
    out = entities.withColumn("errors", F.when(F.coalesce(known, F.lit(False)), none).otherwise(F.array(F.concat(F.lit("Entity type '"), F.coalesce("entity_type", F.lit("")), F.lit("' not found in schema")))))
    out = _property_errors(out, "entity_type", list(schema.entities.values()))
    return out.withColumn("valid", F.size("errors") == 0)


def validate_relationships(relationships: DataFrame, entities: DataFrame, schema: Schema) -> DataFrame:
    """`relationships` with ``errors`` and ``valid``: the type is known, both ends are of types it allows, properties fit."""
    ends = lambda s: entities.select(F.col("id").alias(f"{s}_entity_id"), F.col("entity_type").alias(f"_{s}"))
    out = relationships.join(ends("source"), "source_entity_id", "left").join(ends("target"), "target_entity_id", "left")
    known = F.coalesce(F.col("relationship_type").isin(list(schema.relationships)), F.lit(False))
    out = out.withColumn("errors", F.when(known, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Relationship type '"), F.coalesce("relationship_type", F.lit("")), F.lit("' not found in schema")))))
    for t in schema.relationships.values():
        for side, allowed in (("source", t.sources), ("target", t.targets)):
            if allowed:
                bad = (F.col("relationship_type") == t.name) & ~F.coalesce(F.col(f"_{side}").isin(list(allowed)), F.lit(False))
                out = out.withColumn("errors", F.when(bad, F.array_append("errors", F.lit(f"{side} type not allowed"))).otherwise(F.col("errors")))
    out = _property_errors(out, "relationship_type", list(schema.relationships.values()))
    return out.withColumn("valid", F.size("errors") == 0).drop("_source", "_target")


def closest_type(types: Column, valid: Sequence[str]) -> Column:
    """The valid type equal but for case, else the first that contains it or is contained in it; null if none."""
    names = F.array(*[F.lit(v) for v in valid])
    same = F.filter(names, lambda v: F.lower(v) == F.lower(types))
    near = F.filter(names, lambda v: F.contains(F.lower(v), F.lower(types)) | F.contains(F.lower(types), F.lower(v)))
    return F.coalesce(F.get(same, F.lit(0)), F.get(near, F.lit(0)))


def hierarchy(types: DataFrame, name: str) -> DataFrame:
    """``(name, parent, depth)`` of a type and its parents, from a table of types."""
    types.createOrReplaceTempView("_types")
    safe = name.replace("'", "''")
    return types.sparkSession.sql(f"""
        WITH RECURSIVE up(name, parent, depth) AS (
          SELECT name, parent, 0 FROM _types WHERE name = '{safe}'
          UNION ALL SELECT t.name, t.parent, u.depth + 1 FROM up u JOIN _types t ON t.name = u.parent WHERE u.depth < 64
        ) SELECT * FROM up""")
