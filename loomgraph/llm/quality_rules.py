"""Weak supervision over quality rules, in DataFrame expressions only.

Every rule votes good (1) on a text that is clearly without its fault, bad (0) on
one that has it, and abstains (null) between. Rules are never combined by "all
must pass": an expectation-maximisation over the counts of vote patterns (at most
3^rules rows, whatever the table's size) estimates without labels the share of
good texts and how often each rule votes good on good and on bad texts. A text's
posterior probability of being good follows from its votes, so a rule whose bad
votes stand alone, as `ending` and `digits` do, is outvoted, and one whose bad votes
go together with others' is believed even alone.

Words are runs of characters other than ``\\x20 \\x09-\\x0D``. Defined results:
a null text has no words, so every count is 0 and `base_failed` is true; a text of
any length is read whole; ties at a posterior of exactly one half are kept; repeated
rows get equal results and each counts in the estimation; an empty table gives an
empty table. `annotate` passes extra columns through, except ones named as its
outputs (`STATS`, ``base_failed``, ``votes``, ``posterior``, ``kept``), which it replaces;
`stage` leaves every column of its documents as it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import scratch

WHITE = r"[ \t\n\x0B\f\r]+"
BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_adjacent", "n_upper", "n_banged", "n_digits", "n_ends", "n_plain")
#: A word of letters with one closing mark at most, between white space.
PLAIN = r"(?<=^|[ \t\n\x0B\f\r])\p{L}[\p{L}\p{M}'’-]*[.,;:!?]?(?=[ \t\n\x0B\f\r]|\z)"

#: A closing mark, and quotes or brackets after it, at the end of the text.
ENDS = r"[.!?…:;][\"'”’»)\]]*[ \t\n\x0B\f\r]*\z"


#: Columns that stand for parts while they are measured.
W, L, P = "__rules_words", "__rules_lines", "__rules_plain"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, evaluated once: inside a lambda an outer expression would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))


def repeat_words(words: Column) -> Column:
    """Words within windows of eight words that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash. Sorting (hash, position) puts equal
    windows side by side; the union of the flagged windows is measured by the
    gaps between their sorted positions.
    """
    hashes = let(words, lambda w: F.transform(F.when(F.size(w) >= WINDOW, F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))

    def flagged(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        return F.array_sort(F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(same(i - 1, i), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x["i"])), lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(p, i + 1) - x), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    def measure(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, flagged), covered))

    return let(hashes, measure)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `STATS` and `EXTRA`, all long, in place of columns of those names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            F.aggregate(F.transform(w, lambda x, i: (x == F.get(w, i - 1)).cast("int")), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("n_adjacent"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    plain = {
        "word_chars": without(WHITE),
        "n_symbols": without(r"[^#*$%&|<>]+"),
        "n_upper": without(r"[^A-Z]+"),
        "n_digits": without(r"[^0-9]+"),
        "n_ends": F.rlike(text, F.lit(ENDS)).cast("int"),
        "n_plain": F.regexp_count(text, F.lit(PLAIN)),
        "n_banged": F.char_length(text) - F.char_length(F.replace(text, F.lit("!!"), F.lit("!"))),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*STATS, *EXTRA)]
    own = docs.select(*kept, let(words_of(text), of_words).alias(W), let(lines, of_lines).alias(L), F.struct(*[v.alias(k) for k, v in plain.items()]).alias(P))
    parts = {c: f"{W}.{c}" for c in ("n_words", "n_repeat_words", "n_adjacent")} | {c: f"{L}.{c}" for c in ("n_lines", "n_dup_lines")} | {c: f"{P}.{c}" for c in plain}
    return own.select(*kept, *[F.col(v).cast("long").alias(c) for c, v in parts.items()])


#: Each rule's name, good sign and bad sign, as SQL over the statistics. The last two are weak: clean texts show their fault too.
RULES = (
    ("length", "n_words >= 60", "n_words < 10"),
    ("plain_words", "10 * n_plain >= 9 * n_words", "10 * n_plain < 6 * n_words"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars NOT BETWEEN 2 * n_words AND 15 * n_words"),
    ("symbols", "50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    ("line_copies", "10 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    ("repeated_windows", "20 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    ("stutter", "50 * n_adjacent <= n_words", "5 * n_adjacent > n_words"),
    ("capitals", "10 * n_upper <= word_chars", "5 * n_upper > 2 * word_chars"),
    ("shouting", "50 * n_banged <= n_words", "5 * n_banged > n_words"),
    ("ending", "n_ends = 1", "n_ends = 0"),
    ("digits", "100 * n_digits <= word_chars", "20 * n_digits > word_chars"),
)


def vote(good: str, bad: str) -> str:
    """A rule's vote in SQL. A text without words has no good sign."""
    return f"CASE WHEN {bad} THEN 0 WHEN {good} AND n_words > 0 THEN 1 END"


def rules() -> dict[str, Column]:
    """Votes from the statistics."""
    return {name: F.expr(vote(good, bad)).cast("int") for name, good, bad in RULES}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: The share of good texts at first; how often a rule is thought to vote good on a good and on a bad text; rounds; how many votes on either that belief counts for.
PRIOR, BELIEF, ROUNDS, HOLD = 0.8, (0.99, 0.8), 100, 5.0
Rates = list[tuple[float, float]]


def expectation_maximisation(counts: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS, n_rules: int = 0) -> tuple[float, Rates]:
    """Share of good texts, and for each rule how often it votes good, when it votes, on good texts and on bad texts.

    `counts` are the vote patterns and how many texts have each. Both rates are
    estimated freely; `BELIEF` counts for `HOLD` votes only, which fixes which
    class is called good and keeps rates off zero and one.
    """
    k = len(counts[0][0]) if counts else n_rules
    share, rate = PRIOR, [BELIEF] * k
    total = sum(n for _, n in counts)
    for _ in range(rounds if total else 0):
        mass, seen = 0.0, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(k)]
        for pattern, n in counts:
            p = posterior(pattern, share, rate)
            mass += n * p
            for r, v in enumerate(pattern):
                if v is not None:
                    seen[r][v][0] += n * p
                    seen[r][v][1] += n * (1 - p)
        share = (mass + 1) / (total + 2)
        rate = [tuple((s[1][c] + HOLD * BELIEF[c]) / (s[0][c] + s[1][c] + HOLD) for c in (0, 1)) for s in seen]
    return share, rate


def weights(share: float, rate: Rates) -> tuple[float, Rates]:
    """The prior's log odds, and what a good and a bad vote of each rule add to them."""
    return math.log(share / (1 - share)), [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in rate]


def posterior(pattern: tuple[int | None, ...], share: float, rate: Rates) -> float:
    start, add = weights(share, rate)
    z = start + sum(a[0] if v else a[1] for v, a in zip(pattern, add, strict=True) if v is not None)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def annotate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with its statistics, `base_failed`, `votes` (map of rule to vote), `posterior` and `kept`.

    The statistics are written to the shared folder once, without recomputing
    them for the second look; the texts themselves are written only if `docs`
    has them among its columns.
    """
    return verdicts(ballots(docs, text_col))


def ballots(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with its statistics and a column ``__vote_<rule>`` for each rule."""
    return statistics(docs, text_col).withColumns({f"__vote_{k}": v for k, v in rules().items()}).drop(*EXTRA)


def judge(held: DataFrame, start: float, add: Rates) -> DataFrame:
    names = list(rules())
    z = F.lit(start)
    for k, (good, bad) in zip(names, add, strict=True):
        z = z + F.when(F.col(f"__vote_{k}") == 1, F.lit(good)).when(F.col(f"__vote_{k}") == 0, F.lit(bad)).otherwise(F.lit(0.0))
    votes = F.create_map(*[x for k in names for x in (F.lit(k), F.col(f"__vote_{k}"))])
    out = held.withColumns({"base_failed": base_failed(), "votes": votes, "posterior": 1 / (1 + F.exp(-z))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).drop(*[f"__vote_{k}" for k in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return verdicts(ballots(docs).drop("text")).select("doc_id", *STATS, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def verdicts(voted: DataFrame) -> DataFrame:
    """`posterior` and `kept` from ballots, which are written to the shared folder once."""
    held = scratch.write(voted, "rules")
    counts = [(tuple(r[:-1]), r[-1]) for r in held.groupBy(*[f"__vote_{k}" for k in rules()]).count().collect()]
    counts.sort(key=lambda x: tuple(-1 if v is None else v for v in x[0]))
    return judge(held, *weights(*expectation_maximisation(counts, n_rules=len(rules()))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are kept, with their own columns as they are, whatever their names."""
    whole = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__whole"))
    return verdicts(ballots(whole).drop("text")).where("kept").select("__whole.*")


def oracle() -> str:
    """The same in DuckDB: windows are unnested and counted, and the rounds of the estimation are a recursive table of one row each."""
    names = [n for n, _, _ in RULES]
    votes = ", ".join(f"{vote(good, bad)} AS {n}" for n, good, bad in RULES)
    z = "ln(share / (1 - share))" + "".join(f" + CASE {n} WHEN 1 THEN ln(g_{n} / b_{n}) WHEN 0 THEN ln((1 - g_{n}) / (1 - b_{n})) ELSE 0 END" for n in names)
    post = f"(1 / (1 + exp(-({z}))))"

    def held(n: str, p: str, belief: float) -> str:
        good, either = (f"coalesce(sum(c * {p}) FILTER ({n} {x}), 0)" for x in ("= 1", "IS NOT NULL"))
        return f"({good} + {HOLD} * {belief}) / ({either} + {HOLD})"

    rates = ", ".join(f"{held(n, 'p', BELIEF[0])} AS g_{n}, {held(n, '(1 - p)', BELIEF[1])} AS b_{n}" for n in names)
    first = ", ".join(f"CAST({BELIEF[0]} AS DOUBLE) AS g_{n}, CAST({BELIEF[1]} AS DOUBLE) AS b_{n}" for n in names)
    state = ", ".join(f"g_{n}, b_{n}" for n in names)
    white = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{white}+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM windows JOIN twice USING (doc_id, s)) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{white}')) AS l FROM d),
stats AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  len(l) AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_adjacent, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
  length(t) - length(replace(t, '!!', '!')) AS n_banged, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, CAST(regexp_matches(t, '[.!?…:;]["''”’»)\]]*[ \t\n\v\f\r]*\z') AS INT) AS n_ends, len(list_filter(w, lambda x: regexp_full_match(x, '\p{{L}}[\p{{L}}\p{{M}}''’-]*[.,;:!?]?'))) AS n_plain
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)),
ballots AS (SELECT *, {votes} FROM stats),
counts AS (SELECT {", ".join(names)}, count(*) AS c FROM ballots GROUP BY ALL),
em AS (SELECT 0 AS k, CAST({PRIOR} AS DOUBLE) AS share, {first}
  UNION ALL SELECT k + 1, (sum(c * p) + 1) / (sum(c) + 2), {rates.replace(" AS g_", " AS new_g_").replace(" AS b_", " AS new_b_")}
  FROM (SELECT *, {post} AS p FROM em CROSS JOIN counts WHERE k < {ROUNDS}) GROUP BY k),
done AS (SELECT share, {state} FROM em WHERE k = {ROUNDS})
SELECT doc_id, {", ".join(STATS)}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {post} >= 0.5 AS kept, round({post}, 6) AS posterior
FROM ballots CROSS JOIN done"""
