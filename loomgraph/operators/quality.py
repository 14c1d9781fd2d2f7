"""Quality metrics, issues and reports over entities and relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import clustering, components
from loomgraph.operators.schema import Schema, validate_entities, validate_relationships

#: What an entity of a type should have, thresholds and weights.
REQUIRED = {"person": ("name", "type"), "organization": ("name", "type"), "location": ("name", "type"), "event": ("name", "type", "date"), "concept": ("name", "type", "description")}
REQUIRED_ELSE = ("id", "name", "type")
OPTIONAL = {"person": ("description", "birth_date", "location"), "organization": ("description", "founded_date", "headquarters"), "location": ("description", "coordinates", "country"), "event": ("description", "location", "participants"), "concept": ("category", "related_concepts")}
OPTIONAL_ELSE = ("description",)
LEAST = {"completeness": 0.8, "accuracy": 0.9, "connectivity": 0.7, "consistency": 0.95}
OVERALL = {"completeness": 0.3, "accuracy": 0.3, "connectivity": 0.2, "consistency": 0.2}


def _value(name: str) -> Column:
    return {"id": F.col("id").cast("string"), "name": F.col("name"), "type": F.col("entity_type")}.get(name, F.col("properties")[name])


def _present(name: str) -> Column:
    v = _value(name)
    return (v.isNotNull() & (v != "")).cast("int")


def _by_type(table: dict[str, tuple[str, ...]], other: tuple[str, ...], of) -> Column:
    out = None
    for kind, names in table.items():
        out = (F if out is None else out).when(F.lower("entity_type") == kind, of(names))
    return out.otherwise(of(other))


def _count(names: tuple[str, ...]) -> Column:
    return reduce(Column.__add__, [_present(n) for n in names])


def completeness(entities: DataFrame) -> DataFrame:
    """`entities` with ``completeness``: the share of required values that are there and not empty."""
    return entities.withColumn("completeness", _by_type(REQUIRED, REQUIRED_ELSE, lambda n: _count(n) / len(n)))


def property_coverage(entities: DataFrame) -> DataFrame:
    """One row: coverage of required, optional and all properties."""
    cols = {f"{k}_{what}": _by_type(t, o, f) for k, t, o in (("required", REQUIRED, REQUIRED_ELSE), ("optional", OPTIONAL, OPTIONAL_ELSE)) for what, f in (("there", _count), ("wanted", lambda n: F.lit(len(n))))}
    s = entities.select(*[v.alias(k) for k, v in cols.items()]).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in cols])
    share = lambda a, b: a / F.greatest(F.lit(1), b)
    c = F.col
    return s.select(share(c("required_there"), c("required_wanted")).alias("required_coverage"), share(c("optional_there"), c("optional_wanted")).alias("optional_coverage"), share(c("required_there") + c("optional_there"), c("required_wanted") + c("optional_wanted")).alias("overall_coverage"))


def relationship_complete() -> Column:
    return F.coalesce(F.col("source_entity_id").isNotNull() & F.col("target_entity_id").isNotNull() & (F.col("relationship_type") != ""), F.lit(False))


def completeness_metrics(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entity completeness .4, relationship completeness .3, coverage .3; nothing to look at counts as complete."""
    e = completeness(entities).agg(F.coalesce(F.avg("completeness"), F.lit(1.0)).alias("entity_completeness")).first()[0]
    r = relationships.agg(F.coalesce(F.avg(relationship_complete().cast("double")), F.lit(1.0))).first()[0]
    out = property_coverage(entities).withColumns({"entity_completeness": F.lit(e), "relationship_completeness": F.lit(r)})
    return out.withColumn("score", 0.4 * F.col("entity_completeness") + 0.3 * F.col("relationship_completeness") + 0.3 * F.col("overall_coverage"))


def confidence_buckets(df: DataFrame) -> DataFrame:
    """Rows with high (.8 and over), medium (.6 and over), low and unknown confidence, zeros included."""
    c = F.col("confidence")
    names = ("high", "medium", "low", "unknown")
    bucket = F.when(c.isNull(), "unknown").when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")
    one = df.select(bucket.alias("bucket")).agg(*[F.sum((F.col("bucket") == n).cast("long")).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.coalesce(n, F.lit(0)).alias("n")) for n in names])).alias("x")).select("x.*")


def type_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("type")).agg(F.count("*").alias("n"))


def valid_ends(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """`relationships` with ``valid``: both ends exist and a type is given."""
    ids = entities.select("id").distinct()
    out = relationships.join(ids.select(F.col("id").alias("source_entity_id"), F.lit(True).alias("_s")), "source_entity_id", "left").join(ids.select(F.col("id").alias("target_entity_id"), F.lit(True).alias("_t")), "target_entity_id", "left")
    return out.withColumn("valid", F.coalesce(F.col("_s") & F.col("_t") & (F.col("relationship_type") != ""), F.lit(False))).drop("_s", "_t")


def accuracy(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    return valid_ends(relationships, entities).agg(F.coalesce(F.avg(F.col("valid").cast("double")), F.lit(1.0)).alias("accuracy"))


def accuracy_by_type(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    good = (F.coalesce(F.col("name"), F.lit("")) != "") & F.col("entity_type").isNotNull()
    e = entities.groupBy(F.concat(F.lit("entity_"), "entity_type").alias("key")).agg(F.avg(good.cast("double")).alias("accuracy"))
    r = valid_ends(relationships, entities).groupBy(F.concat(F.lit("relationship_"), "relationship_type").alias("key")).agg(F.avg(F.col("valid").cast("double")).alias("accuracy"))
    return e.unionByName(r)


def schema_compliance(entities: DataFrame, relationships: DataFrame, schema: Schema | None) -> DataFrame:
    if schema is None:
        return entities.agg(F.lit(1.0).alias("compliance"))
    both = validate_entities(entities, schema).select("valid").unionByName(validate_relationships(relationships, entities, schema).select("valid"))
    return both.agg(F.coalesce(F.avg(F.col("valid").cast("double")), F.lit(1.0)).alias("compliance"))


def first_errors(entities: DataFrame, relationships: DataFrame, schema: Schema, most: int = 10) -> DataFrame:
    e = validate_entities(entities, schema).select(F.lit("entity").alias("kind"), "id", F.explode("errors").alias("error"))
    r = validate_relationships(relationships, entities, schema).select(F.lit("relationship").alias("kind"), "id", F.explode("errors").alias("error"))
    return e.unionByName(r).orderBy("kind", "id", "error").limit(most)


def graph_of(relationships: DataFrame) -> DataFrame:
    return relationships.select(F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"))


def connectivity(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """.7 (1 - (components - 1) / (n - 1)) + .3 average clustering; 0 without entities."""
    n = entities.count()
    edges, nodes = graph_of(relationships), entities.select("id")
    c = components(edges, nodes).agg(F.countDistinct("component")).first()[0]
    mean = clustering(edges, nodes).agg(F.avg("coefficient")).first()[0] if n > 2 else 0.0
    score = 0.7 * (1 - (c - 1) / max(1, n - 1)) + 0.3 * (mean or 0.0) if n else 0.0
    return entities.sparkSession.range(1).select(F.lit(n).alias("n"), F.lit(c).alias("components"), F.lit(float(mean or 0.0)).alias("clustering"), F.lit(float(score)).alias("connectivity"))


def connected_share(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    ends = relationships.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id")).distinct()
    own = entities.select("id").join(ends.withColumn("on", F.lit(1)), "id", "left")
    return own.agg(F.coalesce(F.avg(F.coalesce("on", F.lit(0)).cast("double")), F.lit(0.0)).alias("connected_share"))


def consistency_score(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Passed checks over all: an entity has an id and a known type; a relationship has both ends and a type, and is no loop; no id is used twice."""
    e = entities.agg(F.count("*").alias("n"), F.sum((F.col("id").isNotNull() & F.col("entity_type").isNotNull()).cast("int")).alias("ok"), F.countDistinct("id").alias("d")).first()
    r = relationships.agg(F.count("*").alias("n"), F.sum(relationship_complete().cast("int")).alias("ok"), F.sum((~F.coalesce(F.col("source_entity_id") == F.col("target_entity_id"), F.lit(False))).cast("int")).alias("noloop")).first()
    total = 2 * e["n"] + 2 * r["n"]
    passed = (e["ok"] or 0) + (e["d"] or 0) + (r["ok"] or 0) + (r["noloop"] or 0)
    return entities.sparkSession.range(1).select(F.lit(passed / total if total else 1.0).alias("consistency"))


def duplicate_names(entities: DataFrame) -> DataFrame:
    """Names that several entities have, with their number; the ids of a name are not gathered into one row."""
    return entities.where("name is not null and name != ''").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def _issue(df: DataFrame, kind: str, severity: Column, subject: Column, confidence: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("issue_type"), severity.alias("severity"), subject.cast("string").alias("subject"), confidence.alias("confidence"))


def issues(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Duplicates (MEDIUM .8), incomplete entities (below .7; MEDIUM below .5), invalid relationships (HIGH .9), orphans (LOW 1)."""
    half = completeness(entities).where("completeness < 0.7")
    ends = relationships.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id")).distinct()
    return (
        _issue(duplicate_names(entities), "duplicate_entity", F.lit("MEDIUM"), F.col("name"), F.lit(0.8))
        .unionByName(_issue(half, "incomplete_entity", F.when(F.col("completeness") < 0.5, "MEDIUM").otherwise("LOW"), F.col("id"), 1 - F.col("completeness")))
        .unionByName(_issue(valid_ends(relationships, entities).where("not valid"), "invalid_relationship", F.lit("HIGH"), F.col("id"), F.lit(0.9)))
        .unionByName(_issue(entities.join(ends, "id", "left_anti"), "orphaned_entity", F.lit("LOW"), F.col("id"), F.lit(1.0)))
    )


def report(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: the four scores and the overall one (.3, .3, .2, .2)."""
    has = F.avg(((F.col("name").isNotNull()).cast("double") + F.col("entity_type").isNotNull().cast("double")) / 2)
    s = {
        "completeness": entities.agg(F.coalesce(has, F.lit(0.0))).first()[0],
        "accuracy": accuracy(relationships, entities).first()[0],
        "connectivity": connectivity(entities, relationships).first()["connectivity"],
        "consistency": consistency_score(entities, relationships).first()[0],
    }
    out = entities.sparkSession.range(1).select(*[F.lit(float(v)).alias(k) for k, v in s.items()])
    return out.withColumn("overall", reduce(Column.__add__, [w * F.col(k) for k, w in OVERALL.items()]))


def recommendations(scores: DataFrame, found: DataFrame) -> DataFrame:
    """What to do about scores below their thresholds and about issues found; one row each."""
    text = {"completeness": "add missing required properties", "accuracy": "review relationships against the schema", "connectivity": "add relationships between entities", "consistency": "resolve inconsistencies"}
    n = found.agg(*[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(a) for a, c in (("critical", F.col("severity") == "CRITICAL"), ("high", F.col("severity") == "HIGH"), ("copies", F.col("issue_type") == "duplicate_entity"), ("orphans", F.col("issue_type") == "orphaned_entity"))]).first()
    tips = [F.when(F.col(k) < LEAST[k], F.lit(v)) for k, v in text.items()]
    tips += [F.lit(v) for k, v in (("critical", f"address {n['critical']} critical issues"), ("high", f"review {n['high']} high-priority issues"), ("copies", "merge duplicate entities"), ("orphans", "connect orphaned entities")) if n[k]]
    all_ = F.array_compact(F.array(*tips))
    return scores.select(F.explode(F.when(F.size(all_) > 0, all_).otherwise(F.array(F.lit("quality is good")))).alias("recommendation"))


def fallback_scores(n_entities: int, n_relationships: int) -> dict[str, float]:
    """Scores from counts alone."""
    n, m = n_entities, n_relationships
    c, r, k = min(1.0, n / 100), min(1.0, m / max(1, n)), min(1.0, 2 * m / max(1, n))
    return {"completeness": round(c, 2), "accuracy": round(r, 2), "connectivity": round(k, 2), "overall": round((c + r + k) / 3, 2)}
