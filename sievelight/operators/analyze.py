"""Question analysis by rules over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T

# English function words that are no keywords.
FUNCTION_WORDS = sorted({*C.STOPWORDS, *C.FACTOID_WH, *C.DESCRIPTIVE_WH, *C.NEGATION, "do", "does", "did", "has", "have", "had", "will", "would", "can", "could", "may", "might", "should", "there", "their", "his", "her", "he", "she", "they", "we", "i", "you", "than", "then", "so", "if", "into", "about", "also", "both", "between"})


def tokens(query: Column) -> Column:
    """Lower-cased words; hyphens and apostrophes inside a word stay."""
    return F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("([a-z0-9]+(?:[-'][a-z0-9]+)*)"), F.lit(1))


def among(words: Column, closed: list[str]) -> Column:
    listed = F.array(*[F.lit(w) for w in closed])
    return F.filter(words, lambda w: F.array_contains(listed, w))


def has_negation(query: Column) -> Column:
    """A negation word, or a contraction with n't."""
    words = tokens(query)
    return (F.size(among(words, C.NEGATION)) > 0) | F.exists(words, lambda w: w.endswith("n't"))


def entities(query: Column) -> Column:
    """Runs of capitalised words behind the first word, without a leading article, the first surface form of each whatever its case; runs behind in, at or from are places, not subjects."""
    rest = F.regexp_replace(F.trim(F.coalesce(query, F.lit(""))), r"^\S+\s*", "")
    rest = F.regexp_replace(rest, r"\b(in|at|from) [A-Z][A-Za-z0-9]*( [A-Z][A-Za-z0-9]*)*", " ")
    runs = F.regexp_extract_all(rest, F.lit(r"([A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)*)"), F.lit(1))
    bare = F.filter(F.transform(runs, lambda x: F.regexp_replace(x, f"(?i)^(?:{'|'.join(C.DETERMINERS)}) ", "")), lambda x: x != "")
    low = F.transform(bare, lambda x: F.lower(x))
    return F.filter(bare, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def finite_verbs(query: Column) -> Column:
    """Number of finite verbs by rule: auxiliaries, and words in -ed that no auxiliary stands before."""
    words = tokens(query)
    auxiliary = F.array(*[F.lit(w) for w in C.AUXILIARIES])
    before = lambda i: F.when(i > 0, F.element_at(words, i.cast("int"))).otherwise("")
    is_verb = lambda w, i: F.array_contains(auxiliary, w) | (w.endswith("ed") & (F.length(w) > 4) & ~F.array_contains(auxiliary, before(i)))
    return F.size(F.filter(words, is_verb))


def keywords(query: Column) -> Column:
    """Normal forms of content words, each once, in order."""
    stop = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    content = F.filter(tokens(query), lambda w: ~F.array_contains(stop, w) & ~w.endswith("n't"))
    return F.array_distinct(F.transform(content, T.lemma))


def query_type(query: Column) -> Column:
    """First rule that fits: two subjects, two clauses behind a factual question word, two question words, a comparison, joined names; then a factual question word; else descriptive."""
    words = tokens(query)
    wh = F.size(among(words, C.FACTOID_WH + C.DESCRIPTIVE_WH))
    descriptive = F.size(among(words, C.DESCRIPTIVE_WH)) > 0
    joined = F.coalesce(query, F.lit("")).rlike(r"[A-Z][a-z0-9]+ and [A-Z][a-z0-9]+")
    factoid = F.size(among(words, C.FACTOID_WH)) > 0
    # two clauses with a factual question
    clauses = factoid & (finite_verbs(query) >= 2)
    multi = (F.size(entities(query)) >= 2) | clauses | (wh >= 2) | (F.size(among(words, C.COMPARISON)) > 0) | joined
    return F.when(multi, "multi_hop").when(factoid & ~descriptive, "factoid").otherwise("descriptive")


def complexity(query: Column, n_entities: Column, n_keywords: Column) -> Column:
    """low or medium where words, entities and keywords are all within the tier, else high."""
    n = T.word_count(query)
    fits = lambda tier: (n <= C.COMPLEXITY[tier][0]) & (n_entities <= C.COMPLEXITY[tier][1]) & (n_keywords <= C.COMPLEXITY[tier][2])
    return F.when(fits("low"), "low").when(fits("medium"), "medium").otherwise("high")


def analyze(queries: DataFrame) -> DataFrame:
    """(query_id, query, query_type, keywords, entities, has_negation) by rules; a narrow projection."""
    q = F.col("query")
    return queries.select("query_id", "query", query_type(q).alias("query_type"), keywords(q).alias("keywords"), entities(q).alias("entities"), has_negation(q).alias("has_negation"))
