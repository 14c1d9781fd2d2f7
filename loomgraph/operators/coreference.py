"""Coreference within documents: mentions, candidate antecedents, clusters.

A document's mentions meet through keys of sentence numbers (each mention is
sent to the sentences it may refer back to), so joins are equi-joins on
(document, sentence) rather than all pairs of a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import scratch
from loomgraph.functions.text import coreference_similarity
from loomgraph.operators.components import connected_components

# Pronouns with gender, number and the types they stand for; definite phrases; patterns of proper nouns.
PRONOUNS = (
    ("he", "masculine", "singular", "PERSON"), ("him", "masculine", "singular", "PERSON"), ("his", "masculine", "singular", "PERSON"),
    ("she", "feminine", "singular", "PERSON"), ("her", "feminine", "singular", "PERSON"), ("hers", "feminine", "singular", "PERSON"),
    ("it", "neuter", "singular", "ORGANIZATION LOCATION"), ("its", "neuter", "singular", "ORGANIZATION LOCATION"),
    ("they", "neutral", "plural", "PERSON ORGANIZATION"), ("them", "neutral", "plural", "PERSON ORGANIZATION"), ("their", "neutral", "plural", "PERSON ORGANIZATION"), ("theirs", "neutral", "plural", "PERSON ORGANIZATION"),
)
NOMINALS = (
    ("PERSON", ("the person", "the individual", "the man", "the woman", "the ceo", "the founder", "the director")),
    ("ORGANIZATION", ("the company", "the corporation", "the organization", "the firm", "the business")),
    ("LOCATION", ("the location", "the place", "the city", "the country", "the region")),
)
PROPER = (
    ("PERSON", (r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", r"\bDr\. [A-Z][a-z]+ [A-Z][a-z]+\b", r"\bMr\. [A-Z][a-z]+ [A-Z][a-z]+\b", r"\bMs\. [A-Z][a-z]+ [A-Z][a-z]+\b")),
    ("ORGANIZATION", (r"\b[A-Z][a-z]+ Inc\.?\b", r"\b[A-Z][a-z]+ Corp\.?\b", r"\b[A-Z][a-z]+ Corporation\b", r"\b[A-Z][a-z]+ Company\b", r"\b[A-Z]{2,}\b")),
    ("LOCATION", (r"\b[A-Z][a-z]+ City\b", r"\b[A-Z][a-z]+, [A-Z]{2}\b")),
)
#: Literals without which a pattern that has them cannot match: looked for first, since most sentences have none.
LITERALS = ("Dr. ", "Mr. ", "Ms. ", " Inc", " Corporation", " Corp", " Company", " City", ", ")
THRESHOLD, REACH, SAME = 0.6, 5, 0.6


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sentence, n, text, kind, entity_type, gender, number)``; `n` numbers a sentence's mentions."""
    cut = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"[.!?]+")).alias("sentence", "s")).withColumn("s", F.regexp_replace("s", r"^\s+|\s+$", "")).where("s != ''")
    known = {p: (g, n, t) for p, g, n, t in PRONOUNS}
    told = lambda i: F.create_map(*[F.lit(x) for p, v in known.items() for x in (p, v[i])])
    kinds = F.create_map(*[F.lit(x) for t, ps in NOMINALS for p in ps for x in (p, t)])

    def form(x: Column, kind: str, entity_type: Column, gender: Column, number: Column) -> Column:
        return F.struct(x.alias("text"), F.lit(kind).alias("kind"), entity_type.alias("entity_type"), gender.alias("gender"), number.alias("number"))

    def every(pattern: str, possible: Column | None = None) -> Column:
        found = F.regexp_extract_all("s", F.lit(pattern), F.lit(0))
        return found if possible is None else F.when(possible, found).otherwise(F.array().cast("array<string>"))

    def proper(entity_type: str, pattern: str) -> Column:
        needed = next((x for x in LITERALS if x in pattern.replace("\\", "")), None)
        return F.transform(every(pattern, needed and F.contains("s", F.lit(needed))), lambda x: form(x, "proper", F.lit(entity_type), F.lit(""), F.lit("")))

    # longest first: an alternation takes the first that fits
    any_of = lambda ps, possible=None: every(r"(?i)\b(?:" + "|".join(sorted(ps, key=len, reverse=True)) + r")\b", possible)
    nominal = F.contains(F.lower("s"), F.lit("the "))
    found = [
        F.transform(any_of(known), lambda x: form(x, "pronoun", F.element_at(told(2), F.lower(x)), F.element_at(told(0), F.lower(x)), F.element_at(told(1), F.lower(x)))),
        F.transform(any_of([p for _, ps in NOMINALS for p in ps], nominal), lambda x: form(x, "nominal", F.element_at(kinds, F.lower(x)), F.lit(""), F.lit(""))),
        *[proper(t, p) for t, ps in PROPER for p in ps],
    ]
    return cut.select("id", "sentence", F.posexplode(F.array_distinct(F.concat(*found))).alias("n", "m")).select("id", "sentence", "n", "m.*")


def agreement(types: Column, antecedent_type: Column, gender: Column) -> Column:
    """Antecedents carry neither gender nor number: .2 for gender, .15 for number, .3 if the types fit."""
    return F.lit(0.35) + F.when(F.array_contains(F.split(types, " "), antecedent_type), 0.3).otherwise(0.0)


def _back(m: DataFrame, least: int, most: int) -> DataFrame:
    """Each mention once for each sentence it may refer to."""
    return m.select(*[F.col(c).alias(f"m_{c}") for c in m.columns], F.explode(F.sequence(F.col("sentence") - most, F.col("sentence") - least)).alias("sentence")).withColumnRenamed("m_id", "id")


def _similar_texts(proper: DataFrame) -> DataFrame:
    """``(id, entity_type, text, other, sim)``: texts of a document alike enough to refer to each other, once each, both ways and with themselves."""
    # texts meet if they share a word or, for acronyms, initials
    words = F.array_distinct(F.concat(F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != ""), F.array(F.lower(F.array_join(F.transform(F.split("text", r"\s+"), lambda w: F.substring(w, 1, 1)), "")))))
    keyed = proper.select("id", "entity_type", "text").distinct().withColumn("_k", F.explode(words))
    # tables of few distinct texts are small files of many rows: no side may be broadcast by its size
    other = keyed.select("id", "entity_type", "_k", F.col("text").alias("other"))
    pair = keyed.join(other.hint("merge"), ["id", "entity_type", "_k"]).drop("_k").distinct()
    return pair.withColumn("sim", coreference_similarity(F.col("text"), F.col("other"))).where(F.col("sim") > SAME)


def _proper_pairs(proper: DataFrame, nearest: bool) -> DataFrame:
    """``(id, s1, n1, s2, n2, t1, t2, sim)`` of mentions in order, all or those that can be a best link.

    The confidence falls with the distance, and a text occurs once in a sentence:
    of the earlier occurrences of a text only the nearest can be the best. So a
    mention meets each like text twice at most, however often that text recurs.
    """
    like = _similar_texts(proper)
    first = proper.select("id", "entity_type", F.col("sentence").alias("s1"), F.col("n").alias("n1"), F.col("text").alias("other"))
    asks = proper.select("id", "entity_type", F.col("sentence").alias("s2"), F.col("n").alias("n2"), "text").join(like.hint("merge"), ["id", "entity_type", "text"])
    if not nearest:
        both = asks.join(first.hint("merge"), ["id", "entity_type", "other"]).where("s1 < s2 or (s1 = s2 and n1 < n2)")
        return both.select("id", "s1", "n1", "s2", "n2", F.col("other").alias("t1"), F.col("text").alias("t2"), "sim").distinct()
    at = F.struct("s1", "n1")
    rows = asks.withColumn("s", F.col("s2").cast("long")).unionByName(first.withColumn("s", F.col("s1").cast("long")), allowMissingColumns=True)
    seen = Window.partitionBy("id", "entity_type", "other").orderBy("s")
    here = F.max(F.when(F.col("n1").isNotNull(), at)).over(seen.rangeBetween(0, 0))
    before = F.max(F.when(F.col("n1").isNotNull(), at)).over(seen.rangeBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("_b", before).withColumn("_h", here).where("n2 is not null").withColumn("_o", F.explode(F.array_compact(F.array("_b", F.when(F.col("_h.n1") < F.col("n2"), F.col("_h"))))))
    return found.select("id", F.col("_o.s1").alias("s1"), F.col("_o.n1").alias("n1"), "s2", "n2", F.col("other").alias("t1"), F.col("text").alias("t2"), "sim")


def candidates(m: DataFrame, reach: int = REACH, nearest: bool = False) -> DataFrame:
    """Links ``(id, mention, antecedent, confidence, method)`` with mentions as ``sentence:n``.

    All of them, pairs of the copies of a name included, or with `nearest` of the
    links of proper nouns only those to the nearest earlier occurrence of each
    like text and within the sentence: `best_links` over a threshold of more than
    0 gives the same of both.
    """
    key = lambda s, n: F.concat_ws(":", F.col(s).cast("string"), F.col(n).cast("string"))
    proper = m.where("kind = 'proper'")
    near = proper.select("id", "sentence", "n", "text", "entity_type").hint("merge")
    gap = F.col("m_sentence") - F.col("sentence")
    pro = _back(m.where("kind = 'pronoun'"), 1, reach).join(near, ["id", "sentence"])
    agree = agreement(F.col("m_entity_type"), F.col("entity_type"), F.col("m_gender"))
    out = [pro.where(agree > 0.5).select("id", key("m_sentence", "m_n").alias("mention"), key("sentence", "n").alias("antecedent"), (agree * (1 - gap / reach * 0.3)).alias("confidence"), F.lit("pronoun").alias("method"))]
    nom = _back(m.where("kind = 'nominal'"), 0, reach).join(near, ["id", "sentence"]).where("m_entity_type = entity_type")
    out.append(nom.select("id", key("m_sentence", "m_n").alias("mention"), key("sentence", "n").alias("antecedent"), F.least(F.lit(1.0), 0.8 * (1 - gap / reach * 0.2) + 0.1).alias("confidence"), F.lit("nominal").alias("method")))
    # proper nouns refer to any earlier one that is like them
    pair = _proper_pairs(proper, nearest)
    first_is = (F.col("s1") < F.col("s2")) | (F.length("t1") >= F.length("t2"))
    one, two = key("s1", "n1"), key("s2", "n2")
    # at most 1 - reach sentences apart the factor falls to .9; beyond it no further
    far = F.least((F.col("s2") - F.col("s1")) / reach, F.lit(10.0))
    out.append(pair.select("id", F.when(first_is, two).otherwise(one).alias("mention"), F.when(first_is, one).otherwise(two).alias("antecedent"), (F.col("sim") * (1 - far * 0.1)).alias("confidence"), F.lit("proper").alias("method")))
    return reduce(DataFrame.unionByName, out)


def best_links(links: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The most confident antecedent of each mention, ties to the first by name."""
    w = Window.partitionBy("id", "mention").orderBy(F.desc("confidence"), "antecedent")
    return links.where(F.col("confidence") >= threshold).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clusters(m: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, cluster, canonical, size, confidence)``: connected mentions; the longest proper noun names them."""
    best = scratch.write(best_links(links), "links")
    name = lambda c: F.concat_ws("/", F.col("id").cast("string"), c)
    # joined by sorting: these files of few distinct texts may hold many more rows than a driver can broadcast
    own = scratch.write(connected_components(best.select(name("mention").alias("u"), name("antecedent").alias("v"))), "own").hint("merge")
    table = m.withColumn("node", F.concat_ws("/", F.col("id").cast("string"), F.concat_ws(":", F.col("sentence").cast("string"), F.col("n").cast("string"))))
    member = table.join(own, "node")
    conf = best.select(name("mention").alias("node"), "confidence").join(own, "node").groupBy("component").agg(F.avg("confidence").alias("confidence"))
    top = F.struct((F.col("kind") == "proper").cast("int"), F.length("text"), -F.col("sentence"), F.col("text"))
    out = member.groupBy("id", "component").agg(F.max_by("text", top).alias("canonical"), F.count("*").alias("size"))
    return out.join(conf.hint("merge"), "component").select("id", F.col("component").alias("cluster"), "canonical", "size", F.coalesce("confidence", F.lit(0.8)).alias("confidence"))


def basic_pronouns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pronouns that occur anywhere in a text, as a substring, confidence .2."""
    names = F.array(*[F.lit(p) for p, *_ in PRONOUNS])
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.filter(names, lambda p: F.contains(F.lower(F.col(text_col)), p))).alias("pronoun"), F.lit(0.2).alias("confidence"))
