"""Consistency rules: each is a function of entities and relationships to rows of violations.

A violation has ``violation_type, severity, rule, subject, detail, confidence``.
Type names are compared in lower case; dates and other values are read from the
``properties`` map.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import date_shape, parse_date
from loomgraph.operators.graph import cycles

#: Relationship types and properties that the rules look at.
HIERARCHICAL = ("part_of", "belongs_to", "contains", "manages", "supervises", "parent_of", "child_of", "owns", "member_of")
CARDINALITIES = (("married_to", 0, 1), ("born_in", 1, 1), ("ceo_of", 0, 1), ("headquarters_in", 0, 1))
EXCLUSIONS = (("employed_by", "unemployed"), ("alive", "deceased"), ("active", "inactive"), ("public_company", "private_company"))
SYMMETRIC = ("married_to", "partners_with", "allied_with", "connected_to")
TRANSITIVE = ("part_of", "located_in", "subclass_of")
INVERSES = (("parent_of", "child_of"), ("owns", "owned_by"), ("manages", "managed_by"), ("teaches", "taught_by"), ("employs", "employed_by"))
PERIODS = (("event", "start_date", "end_date"), ("person", "birth_date", "death_date"), ("organization", "founded_date", "dissolved_date"))
DATES = ("date", "start_date", "end_date", "birth_date", "death_date", "founded_date", "created_date")
ENTITY_DATES = ("date", "start_date", "created_date", "birth_date", "founded_date")
NUMBERS = ("age", "year", "count", "quantity", "amount")
FORMATS = (("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), ("url", r"^https?://[^\s]+$"), ("phone", r"^[\+]?[1-9][\d]{0,15}$"))

Rule = Callable[[DataFrame, DataFrame], DataFrame]


def _rows(df: DataFrame, kind: str, severity: str, rule: str, subject: Column, detail: Column, confidence: float | Column = 1.0) -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return df.select(F.lit(kind).alias("violation_type"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"), c.alias("confidence"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def property_of(name: str) -> Column:
    return F.col("properties")[name]


def temporal(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Periods that end before they begin."""
    parts = []
    for kind, a, b in PERIODS:
        late = entities.where((F.lower("entity_type") == kind) & (parse_date(property_of(a)) > parse_date(property_of(b))))
        parts.append(_rows(late, "temporal_conflict", "HIGH", "temporal_consistency", F.col("id"), F.lit(f"{a} after {b}")))
    return _union(parts)


def before_edges(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Edges of type "before" whose source is not earlier than its target."""
    day = F.coalesce(*[parse_date(property_of(p)) for p in ENTITY_DATES])
    own = entities.select("id", day.alias("day"))
    a, b = (own.select(F.col("id").alias(f"{s}_entity_id"), F.col("day").alias(s)) for s in ("source", "target"))
    late = relationships.where("relationship_type = 'before'").join(a, "source_entity_id").join(b, "target_entity_id").where("source >= target")
    return _rows(late, "temporal_conflict", "MEDIUM", "temporal_ordering", F.col("id"), F.concat_ws(">", "source_entity_id", "target_entity_id"), 0.8)


def circular(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    parts = []
    for kind in HIERARCHICAL:
        own = relationships.where(F.col("relationship_type") == kind).select(F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"))
        if own.limit(1).count():
            found = cycles(own)
            parts.append(_rows(found, "circular_dependency", "CRITICAL", "circular_dependency", F.lit(kind), F.array_join("path", ">")))
    return _union(parts) if parts else _rows(relationships.where("false"), "circular_dependency", "CRITICAL", "circular_dependency", F.lit(""), F.lit(""))


def cardinality(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Sources with fewer or more relationships of a type than it allows; sources without any are not looked at."""
    limit = F.create_map(*[F.lit(x) for k, _, most in CARDINALITIES for x in (k, most)])
    own = relationships.where(F.col("relationship_type").isin([k for k, _, _ in CARDINALITIES])).groupBy("source_entity_id", "relationship_type").agg(F.count("*").alias("n"))
    return _rows(own.where(F.col("n") > F.element_at(limit, F.col("relationship_type"))), "cardinality_violation", "HIGH", "cardinality", F.col("source_entity_id"), F.concat_ws(":", "relationship_type", F.col("n").cast("string")))


def exclusion(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Sources with both types of a pair that excludes itself."""
    parts = []
    for a, b in EXCLUSIONS:
        has = relationships.where(F.col("relationship_type").isin(a, b)).groupBy("source_entity_id").agg(F.max((F.col("relationship_type") == a).cast("int")).alias("a"), F.max((F.col("relationship_type") == b).cast("int")).alias("b"))
        parts.append(_rows(has.where("a = 1 and b = 1"), "mutual_exclusion", "HIGH", "mutual_exclusion", F.col("source_entity_id"), F.lit(f"{a}|{b}")))
    return _union(parts)


def referential(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships with an end that is no entity."""
    ids = entities.select("id")
    parts = []
    for end in ("source", "target"):
        c = f"{end}_entity_id"
        parts.append(_rows(relationships.join(ids.select(F.col("id").alias(c)), c, "left_anti"), "referential_integrity", "CRITICAL", "referential_integrity", F.col("id"), F.concat_ws(":", F.lit(end), c)))
    return _union(parts)


def _properties(entities: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return entities.select("id", F.explode("properties").alias("name", "value")).where(F.col("name").isin(list(names)) & F.col("value").isNotNull())


def date_formats(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Values whose date format is not the property's most frequent one (ties to the first by name); unknown formats are left alone."""
    own = _properties(entities, DATES).withColumn("shape", date_shape(F.col("value"))).where("shape != 'unknown'")
    most = own.groupBy("name", "shape").agg(F.count("*").alias("n")).groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "shape"))["shape"].alias("usual"))
    odd = own.join(most, "name").where("shape != usual")
    return _rows(odd, "data_type_inconsistency", "LOW", "date_format", F.col("id"), F.concat_ws(":", "name", "shape"), 0.7)


def numbers(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    own = _properties(entities, NUMBERS).withColumn("number", F.expr("try_cast(value as double)"))
    age = own.where("name = 'age' and (number < 0 or number > 150)")
    return _union([
        _rows(own.where("number is null"), "data_type_inconsistency", "MEDIUM", "numeric", F.col("id"), F.concat_ws(":", "name", "value")),
        _rows(age, "data_type_inconsistency", "MEDIUM", "numeric", F.col("id"), F.concat_ws(":", "name", "value"), 0.9),
    ])


def formats(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    own = _properties(entities, tuple(n for n, _ in FORMATS))
    wrong = reduce(Column.__or__, [(F.col("name") == n) & ~F.rlike(F.col("value"), F.lit(p)) for n, p in FORMATS])
    return _rows(own.where(wrong), "data_type_inconsistency", "LOW", "string_format", F.col("id"), F.concat_ws(":", "name", "value"), 0.8)


def _triples(relationships: DataFrame) -> DataFrame:
    return relationships.select(F.col("source_entity_id").alias("s"), F.col("target_entity_id").alias("t"), F.col("relationship_type").alias("k")).distinct()


def symmetric(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    own = _triples(relationships).where(F.col("k").isin(list(SYMMETRIC)))
    back = own.select(F.col("t").alias("s"), F.col("s").alias("t"), "k")
    return _rows(own.join(back, ["s", "t", "k"], "left_anti"), "logical_inconsistency", "MEDIUM", "symmetric", F.concat_ws(">", "s", "t"), F.col("k"), 0.9)


def transitive(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """a to b to c without a to c, for different a and c."""
    own = _triples(relationships).where(F.col("k").isin(list(TRANSITIVE)))
    two = own.join(own.select(F.col("s").alias("t"), F.col("t").alias("c"), "k"), ["t", "k"]).where("s != c").select("s", F.col("c").alias("t"), "k").distinct()
    return _rows(two.join(own, ["s", "t", "k"], "left_anti"), "logical_inconsistency", "LOW", "transitive", F.concat_ws(">", "s", "t"), F.col("k"), 0.6)


def inverse(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships of the first type of a pair without the second the other way round."""
    other = F.create_map(*[F.lit(x) for pair in INVERSES for x in pair])
    all_ = _triples(relationships)
    own = all_.where(F.col("k").isin([a for a, _ in INVERSES])).withColumn("i", F.element_at(other, F.col("k")))
    back = all_.select(F.col("t").alias("s"), F.col("s").alias("t"), F.col("k").alias("i"))
    return _rows(own.join(back, ["s", "t", "i"], "left_anti"), "logical_inconsistency", "MEDIUM", "inverse", F.concat_ws(">", "s", "t"), F.concat_ws("|", "k", "i"), 0.8)


RULES: dict[str, Rule] = {
    "temporal": temporal,
    "before_edges": before_edges,
    "circular": circular,
    "cardinality": cardinality,
    "exclusion": exclusion,
    "referential": referential,
    "date_formats": date_formats,
    "numbers": numbers,
    "formats": formats,
}
#: Asked for by name only.
LOGICAL: dict[str, Rule] = {"symmetric": symmetric, "transitive": transitive, "inverse": inverse}


def check(entities: DataFrame, relationships: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Violations of all rules; a rule that can't be planned gives one row that says so."""
    parts = []
    for name, rule in (RULES if rules is None else rules).items():
        try:
            parts.append(rule(entities, relationships))
        except Exception as e:  # noqa: BLE001 - a broken rule is a finding, not an end
            one = entities.sparkSession.range(1)
            parts.append(_rows(one, "schema_violation", "WARNING", name, F.lit(name), F.lit(str(e)[:200])))
    return _union(parts)
