"""Named requests over a bank's tables, each answered by a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import consistency, coreference, extraction, graph, quality, relations, resolution, search, store

EMPTY = {
    "entities": "bank string, id string, name string, entity_type string, properties map<string,string>, confidence double",
    "relationships": "bank string, id string, source_entity_id string, target_entity_id string, relationship_type string, properties map<string,string>, confidence double, weight double, context string",
    "observations": "bank string, id string, entity_id string, content string, timestamp timestamp",
    "reasoning_steps": "bank string, id string, step_number int, reasoning string, thought string",
}


@dataclass
class Bank:
    """Tables of all banks and which one is current. Every change replaces a table; earlier DataFrames stay as they were."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    current: str = store.DEFAULT_BANK

    def __post_init__(self) -> None:
        for name, schema in EMPTY.items():
            if name not in self.tables:
                self.tables[name] = self.spark.createDataFrame([], schema)

    def of(self, name: str, bank: str | None = None) -> DataFrame:
        return self.tables[name].where(F.col("bank") == (bank or self.current))

    def graph(self, bank: str | None = None) -> tuple[DataFrame, DataFrame]:
        r = self.of("relationships", bank)
        edges = r.select(F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.col("relationship_type").alias("edge_type"))
        nodes = self.of("entities", bank).select("id")
        return graph.simple_edges(edges, nodes), nodes

    # banks
    def list_banks(self) -> DataFrame:
        return store.bank_counts(**self.tables)

    def select_bank(self, bank: str) -> None:
        self.current = bank

    def delete_bank(self, bank: str) -> None:
        self.tables = {k: store.drop_bank(v, bank) for k, v in self.tables.items()}
        if self.current == bank:
            self.current = store.DEFAULT_BANK

    def clear_bank(self, bank: str) -> None:
        self.tables = {k: store.clear_bank(v, bank) for k, v in self.tables.items()}

    # changes
    def _add(self, kind: str, rows: list[dict[str, Any]]) -> DataFrame:
        schema = self.tables[kind].schema
        full = [{f.name: r.get(f.name) for f in schema.fields} | {"bank": r.get("bank", self.current)} for r in rows]
        return self.spark.createDataFrame(full, schema)

    def create_entities(self, rows: list[dict[str, Any]]) -> int:
        own, made = store.create_entities(self.of("entities"), self._add("entities", rows))
        n = made.count()
        self.tables["entities"] = self.tables["entities"].unionByName(made)
        return n

    def create_relations(self, rows: list[dict[str, Any]]) -> int:
        full = [r | {"id": r.get("id") or f"{r['source_entity_id']}-{r['relationship_type']}-{r['target_entity_id']}"} for r in rows]
        _, made = store.create_relationships(self.of("relationships"), self._add("relationships", full), self.of("entities"))
        n = made.count()
        self.tables["relationships"] = self.tables["relationships"].unionByName(made)
        return n

    def add_observations(self, rows: list[dict[str, Any]]) -> None:
        self.tables["observations"] = store.add_observations(self.tables["observations"], self._add("observations", rows), self.of("entities"))

    def delete_observations(self, entity_id: str, contents: list[str]) -> None:
        self.tables["observations"] = self.tables["observations"].where(~((F.col("entity_id") == entity_id) & F.col("content").isin(contents)))

    def add_step(self, row: dict[str, Any]) -> None:
        self.tables["reasoning_steps"] = self.tables["reasoning_steps"].unionByName(self._add("reasoning_steps", [row]))

    def delete_entities(self, ids: list[str], cascade: bool = True) -> None:
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        e, r = store.delete_entities(self.of("entities"), self.of("relationships"), gone, cascade)
        rest = lambda k: self.tables[k].where(~F.col("bank").eqNullSafe(F.lit(self.current)))
        self.tables["entities"], self.tables["relationships"] = rest("entities").unionByName(e), rest("relationships").unionByName(r)

    def delete_relations(self, triples: list[tuple[str, str, str]]) -> None:
        gone = self.spark.createDataFrame(triples, "source_entity_id string, target_entity_id string, relationship_type string")
        self.tables["relationships"] = store.delete_relationships(self.tables["relationships"], gone)

    def ingest(self, docs: DataFrame, source: str = "text") -> tuple[DataFrame, DataFrame]:
        """Entities and relations of texts, added unless they are there; returns what was added."""
        found = extraction.extract_entities(docs)
        new = extraction.upsert_graph(self.of("entities"), found).select(F.lit(self.current).alias("bank"), "id", "name", "entity_type")
        entities = self.tables["entities"].unionByName(new, allowMissingColumns=True)
        linked = relations.sentence_relations(docs, found).dropDuplicates(["source", "target", "relationship_type"])
        edges = linked.select(F.lit(self.current).alias("bank"), F.concat_ws("-", "source", "relationship_type", "target").alias("id"), F.col("source").alias("source_entity_id"), F.col("target").alias("target_entity_id"), "relationship_type", "confidence", "context")
        edges = edges.join(self.of("relationships").select("id"), "id", "left_anti")
        self.tables["entities"] = entities
        self.tables["relationships"] = self.tables["relationships"].unionByName(edges, allowMissingColumns=True)
        return new, edges


def read_graph(bank: Bank) -> DataFrame:
    """Every row of the current bank as JSON, tagged with its kind."""
    parts = [bank.of(k).select(F.lit(k).alias("kind"), F.to_json(F.struct("*")).alias("row")) for k in EMPTY]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _analytics(bank: Bank, analysis: str = "full", **options) -> DataFrame:
    edges, nodes = bank.graph()
    kinds: dict[str, Callable[[], DataFrame]] = {
        "centrality": lambda: graph.importance(edges, nodes),
        "community": lambda: graph.communities(edges, nodes, options.get("min_size", 3)),
        "paths": lambda: graph.simple_paths(edges, options["source"], options["target"], options.get("cutoff", 4), options.get("most", 10)),
        "neighborhood": lambda: graph.neighbourhood(edges, options["node"], options.get("radius", 1), nodes),
        "metrics": lambda: graph.density(edges, nodes),
        "full": lambda: graph.summary(edges, nodes),
    }
    if analysis not in kinds:
        raise ValueError(f"unknown analysis {analysis!r}; known: {', '.join(kinds)}")
    return kinds[analysis]()


#: Requests that read; each takes the bank and its arguments.
REQUESTS: dict[str, Callable[..., DataFrame]] = {
    "list_banks": lambda b: b.list_banks(),
    "read_graph": read_graph,
    "entities": lambda b: b.of("entities"),
    "relations": lambda b: b.of("relationships"),
    "observations": lambda b: b.of("observations"),
    "reasoning_steps": lambda b: b.of("reasoning_steps").orderBy("step_number", "id"),
    "open_nodes": lambda b, names: store.open_nodes(b.of("entities"), names),
    "search_nodes": lambda b, query, **o: search.search_blob(b.of("entities"), query, search.entity_blob(), **o),
    "search_entities": lambda b, query, **o: search.search_entities(b.of("entities"), query, **o),
    "search_relationships": lambda b, query, **o: search.search_relationships(b.of("relationships"), query, **o),
    "search_observations": lambda b, query, **o: search.search_observations(b.of("observations"), query, **o),
    "search_all": lambda b, query, **o: search.search_all(b.of("entities"), b.of("relationships"), b.of("observations"), query, **o),
    "visualization_nodes": lambda b: store.export_nodes(b.of("entities"), b.of("observations")),
    "visualization_edges": lambda b: store.export_edges(b.of("relationships")),
    "analytics": _analytics,
    "quality": lambda b: quality.report(b.of("entities"), b.of("relationships")),
    "issues": lambda b: quality.issues(b.of("entities"), b.of("relationships")),
    "consistency": lambda b, rules=None: consistency.check(b.of("entities"), b.of("relationships"), rules),
    "resolve": lambda b: resolution.matches(b.of("entities")),
    "extract_entities": lambda b, docs: extraction.extract_entities(docs),
    "extract_relationships": lambda b, docs: relations.sentence_relations(docs, extraction.extract_entities(docs)),
    "resolve_coreferences": lambda b, docs: coreference.clusters(m := coreference.mentions(docs), coreference.candidates(m, nearest=True)),
}


def answer(bank: Bank, request: str, **arguments) -> DataFrame:
    if request not in REQUESTS:
        raise ValueError(f"unknown request {request!r}")
    return REQUESTS[request](bank, **arguments)
