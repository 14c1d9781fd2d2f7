"""String functions as column expressions: similarity, relevance, normalisation, dates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, evaluated once even where a lambda uses it for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def fuzzy_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on trimmed lower case; 0 if either is empty or null."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    longest = F.greatest(F.length(x), F.length(y))
    value = F.when(x == y, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)
    return F.when((F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0), F.lit(ZERO)).otherwise(value)


def matches(query: str, text: Column, case_sensitive: bool = False, use_regex: bool = False, fuzzy: bool = False, threshold: float = 0.8) -> Column:
    """Whether `text` has the query: by pattern, as a substring, or by similarity to the text or one of its words."""
    if not query:
        return F.lit(False)
    if use_regex:
        try:
            re.compile(query)
            return F.coalesce(F.when(F.length(text) > 0, F.regexp_like(text, F.lit(query if case_sensitive else f"(?i){query}"))), F.lit(False))
        except re.error:
            pass
    hit = F.contains(text, F.lit(query)) if case_sensitive else F.contains(F.lower(text), F.lit(query.lower()))
    if fuzzy:
        q = F.lit(query)
        hit = hit | (fuzzy_similarity(q, text) >= threshold) | F.exists(words(text), lambda w: fuzzy_similarity(q, w) >= threshold)
    return F.coalesce(F.when(F.length(text) > 0, hit), F.lit(False))


def relevance(query: str, text: Column, bonus: float = 0.5, fuzzy: bool = False, threshold: float = 0.8) -> Column:
    """Equality 1; whole word .8 + bonus; substring min(.7, .3 + coverage); similar text .6, similar word .5 of the similarity; else 0."""
    if not query:
        return F.lit(ZERO)
    q, low = F.lit(query.lower()), F.lower(text)
    out = F.when(low == q, F.lit(1.0))
    out = out.when(F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(f" {query.lower()} ")), F.lit(0.8 + bonus))
    out = out.when(F.contains(low, q), F.least(F.lit(0.7), F.lit(0.3) + F.lit(len(query)) / F.length(low)))
    if fuzzy:
        whole = fuzzy_similarity(F.lit(query), text)
        word = F.array_max(F.transform(words(text), lambda w: fuzzy_similarity(F.lit(query), w)))
        out = out.when(whole >= threshold, whole * 0.6).when(word >= threshold, word * 0.5)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(ZERO)).otherwise(out.otherwise(F.lit(ZERO)))


PREFIXES = ("mr.", "mrs.", "dr.", "prof.", "the ", "a ")
SUFFIXES = (" inc.", " corp.", " ltd.", " llc.", " co.")


def normalised_name(name: Column) -> Column:
    """Lower case, white space collapsed, each prefix and suffix dropped in turn, punctuation dropped."""
    out = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    for p in PREFIXES:
        out = F.trim(F.regexp_replace(out, "^" + re.escape(p), ""))
    for x in SUFFIXES:
        out = F.trim(F.regexp_replace(out, re.escape(x) + "$", ""))
    return F.trim(F.regexp_replace(out, r"[^\w\s]", ""))


def initials(name: Column) -> Column:
    """First letters of the words that begin with a letter, in upper case."""
    firsts = F.transform(words(name), lambda w: F.upper(F.substring(w, 1, 1)))
    return F.array_join(F.filter(firsts, lambda c: F.rlike(c, F.lit(r"^\p{L}$"))), "")


def aliases(name: Column, kind: Column) -> Column:
    """Other names: the normalised name; an acronym for organisations of two words or more; first and last name and initials for persons."""
    w = words(name)
    org = F.lower(kind).isin("organization", "company")
    person = F.lower(kind) == "person"
    several = F.size(w) >= 2
    out = F.array_compact(
        F.array(
            normalised_name(name),
            F.when(org & several & (F.length(initials(name)) >= 2), initials(name)),
            F.when(person & several, w[0]),
            F.when(person & several, F.element_at(w, -1)),
            F.when(person & several, initials(name)),
        )
    )
    return F.array_distinct(out)


def title_if_one_case(text: Column) -> Column:
    return F.when((text == F.upper(text)) | (text == F.lower(text)), F.initcap(text)).otherwise(text)


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(ZERO)).otherwise(F.size(F.array_intersect(x, y)) / union)


def coreference_similarity(a: Column, b: Column) -> Column:
    """Equal 1; one within the other: shorter / longer length; acronym .9; else Jaccard of the words."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    acronym = lambda s, t: (F.size(words(s)) == 1) & (F.size(words(t)) > 1) & (F.upper(s) == initials(t))
    out = F.when(x == y, F.lit(1.0)).when(F.contains(x, y) | F.contains(y, x), short / long_)
    return out.when(acronym(x, y) | acronym(y, x), F.lit(0.9)).otherwise(jaccard(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is zero, null or the lengths differ."""
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(ZERO), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(ZERO), add))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot / size).otherwise(F.lit(ZERO))


#: Date patterns tried in this order, and the shapes that tell a format.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM", "yyyy")
DATE_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}$", "YYYY-MM-DD"),
    (r"^\d{4}/\d{2}/\d{2}$", "YYYY/MM/DD"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/DD/YYYY"),
    (r"^\d{4}-\d{2}$", "YYYY-MM"),
    (r"^\d{4}$", "YYYY"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "ISO"),
)


def parse_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def date_shape(text: Column) -> Column:
    out = None
    for pattern, name in DATE_SHAPES:
        out = (F if out is None else out).when(F.rlike(text, F.lit(pattern)), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def clean_phrase(text: Column) -> Column:
    """Without articles and closing marks, white space collapsed."""
    out = F.regexp_replace(text, r"(?i)\b(the|a|an|this|that|these|those)\b", "")
    return F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"[.,;:!?]+$", "")


def context_window(text: Column, start: Column, end: Column, around: int = 50) -> Column:
    """Characters from `around` before `start` to `around` after `end` (offsets from 0)."""
    lo = F.greatest(F.lit(0), start - around)
    return F.trim(F.substr(text, (lo + 1).cast("int"), (F.least(F.length(text), end + around) - lo).cast("int")))


def sentences(text: Column, marks: str = r"[.!?;]") -> Column:
    return F.filter(F.transform(F.split(text, marks), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def index_key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def canonical_form(text: Column, kind: Column) -> Column:
    """Persons in title case; organisations with their suffix capitalised and dotted."""
    org = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?i)\binc\.?$", "INC."), r"(?i)\bcorp\.?$", "CORP."), r"(?i)\bltd\.?$", "LTD.")
    return F.when(F.lower(kind) == "person", F.initcap(text)).when(F.lower(kind) == "organization", org).otherwise(text)


def observation_text(value: Column) -> Column:
    """The content of an observation given as JSON object or as plain text."""
    return F.coalesce(F.get_json_object(value, "$.content"), value)


# Labels of recognisers and lemmas of verbs, and what they stand for.
LABELS = {"PER": "person", "PERSON": "person", "ORG": "organization", "GPE": "location", "LOC": "location", "EVENT": "event", "PRODUCT": "product", "DATE": "date", "MONEY": "money", "QUANTITY": "quantity", "MISC": "misc"}
LEMMAS = (
    ("causes", "cause lead result trigger induce provoke"),
    ("creates", "create produce generate make build develop form"),
    ("contains", "contain include have hold comprise consist"),
    ("located_in", "locate situate position place base"),
    ("part_of", "part component element piece section"),
    ("type_of", "type kind form variety class category"),
    ("owns", "own possess belong control"),
    ("works_for", "work employ serve represent"),
    ("collaborates_with", "collaborate cooperate partner"),
    ("influences", "influence affect impact shape determine"),
    ("uses", "use utilize employ apply leverage"),
    ("develops", "develop design build create engineer"),
    ("manages", "manage lead direct oversee supervise"),
    ("competes_with", "compete rival oppose challenge"),
    ("similar_to", "similar like resemble comparable equivalent"),
)
TRAILING = ("for", "and", "or", "the", "of", "in", "at", "by", "with", "from", "to")


def type_of_label(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), label)


def relation_of_lemma(lemma: Column) -> Column:
    """The first relation that knows the lemma, null if none does."""
    out = None
    for kind, known in LEMMAS:
        out = (F if out is None else out).when(F.lower(lemma).isin(known.split()), F.lit(kind))
    return out


def clean_context(text: Column) -> Column:
    """Each word without its closing mark (but . and -), trailing function words dropped."""
    plain = F.filter(F.transform(words(text), lambda w: F.regexp_replace(w, r"[^\w\s.\-]$", "")), lambda w: w != "")
    return F.regexp_replace(F.array_join(plain, " "), r"(?i)(?:(?:^|\s+)(?:" + "|".join(TRAILING) + r"))+$", "")


def normalised_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def first_date(properties: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[parse_date(properties[n]) for n in names])
