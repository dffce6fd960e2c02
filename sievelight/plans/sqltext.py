"""Pieces of SQL that several oracle statements share."""

from __future__ import annotations

from .. import config as C
from ..functions.text import TOKEN
from ..operators.analyze import FUNCTION_WORDS


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def singular(x: str) -> str:
    return (
        f"CASE WHEN length({x}) > 4 AND {x} LIKE '%ies' THEN substr({x}, 1, length({x}) - 3) || 'y' WHEN length({x}) > 4 AND regexp_matches({x}, '(s|x|z|ch|sh)es$') THEN substr({x}, 1, length({x}) - 2) "
        f"WHEN length({x}) > 3 AND {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"
    )


def stripped(t: str) -> str:
    return f"CASE WHEN length({t}) > 5 AND {t} LIKE '%ing' THEN substr({t}, 1, length({t}) - 3) WHEN length({t}) > 4 AND {t} LIKE '%ed' THEN substr({t}, 1, length({t}) - 2) ELSE {t} END"


def lemmas(words: str) -> str:
    """List of normal forms of a list of words."""
    return f"list_transform(list_transform({words}, lambda x: {singular('x')}), lambda t: {stripped('t')})"


def runs(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')"


def term_set(text: str) -> str:
    return f"list_distinct(list_transform({runs(text)}, lambda x: {singular('x')}))"


def index_tokens(text: str) -> str:
    return f"list_filter({runs(text)}, lambda x: NOT list_contains({listed(C.STOPWORDS)}, x))"


def query_tokens(q: str) -> str:
    return f"regexp_extract_all(lower(coalesce({q}, '')), '[a-z0-9]+(?:[-''][a-z0-9]+)*')"


def among(words: str, closed: list[str]) -> str:
    return f"len(list_filter({words}, lambda x: list_contains({listed(closed)}, x)))"


def entities(q: str) -> str:
    rest = rf"regexp_replace(trim(coalesce({q}, ''), ' '), '^\S+\s*', '')"
    rest = rf"regexp_replace({rest}, '\b(in|at|from) [A-Z][A-Za-z0-9]*( [A-Z][A-Za-z0-9]*)*', ' ', 'g')"
    runs_ = f"regexp_extract_all({rest}, '[A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)*')"
    bare = f"list_filter(list_transform({runs_}, lambda x: regexp_replace(x, '(?i)^(?:{'|'.join(C.DETERMINERS)}) ', '')), lambda x: x <> '')"
    return f"list_filter({bare}, lambda x, i: list_position(list_transform({bare}, lambda y: lower(y)), lower(x)) = i)"


def finite_verbs(q: str) -> str:
    t = query_tokens(q)
    return f"len(list_filter({t}, lambda w, i: list_contains({listed(C.AUXILIARIES)}, w) OR (w LIKE '%ed' AND length(w) > 4 AND NOT list_contains({listed(C.AUXILIARIES)}, CASE WHEN i > 1 THEN ({t})[i - 1] ELSE '' END))))"


def keywords(q: str) -> str:
    return f"list_distinct({lemmas(f'list_filter({query_tokens(q)}, lambda w: NOT list_contains({listed(FUNCTION_WORDS)}, w) AND w NOT LIKE {chr(39)}%n{chr(39)}{chr(39)}t{chr(39)})')})"


def query_type(q: str) -> str:
    t = query_tokens(q)
    return (
        f"CASE WHEN len({entities(q)}) >= 2 OR ({among(t, C.FACTOID_WH)} > 0 AND {finite_verbs(q)} >= 2) OR {among(t, C.FACTOID_WH + C.DESCRIPTIVE_WH)} >= 2 OR {among(t, C.COMPARISON)} > 0 OR regexp_matches(coalesce({q}, ''), '[A-Z][a-z0-9]+ and [A-Z][a-z0-9]+') THEN 'multi_hop' "
        f"WHEN {among(t, C.FACTOID_WH)} > 0 AND {among(t, C.DESCRIPTIVE_WH)} = 0 THEN 'factoid' ELSE 'descriptive' END"
    )


WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')"


def word_count(text: str) -> str:
    return f"len({WORDS.format(text)})"


def token_count(text: str) -> str:
    return f"len(regexp_extract_all(coalesce({text}, ''), '{TOKEN}'))"


def clean(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ')"


def parts(text: str) -> str:
    marked = rf"""regexp_replace(coalesce({text}, ''), '([.!?])[ \t]+([A-Z0-9"“])', '\1' || chr(1) || '\2', 'g')"""
    return rf"string_split(regexp_replace({marked}, '[\r\n]+', chr(1), 'g'), chr(1))"


def verdict(s: str) -> str:
    least, most = C.SENTENCE_TOKENS
    return f"CASE WHEN length({s}) = 0 OR regexp_matches(substr({s}, 1, 1), '{C.FRAGMENT_START}') THEN 'fragment' WHEN {word_count(s)} < {least} THEN 'short' WHEN {word_count(s)} > {most} THEN 'long' ELSE 'keep' END"


def cosine(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"


def counted(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({text}, ''), '{pattern}'))"


def by_type(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


ONE_SENTENCE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY query_id) AS one FROM sentences) WHERE one = 1)"
CHUNKS = "(SELECT chunk_idx, min(chunk_text) AS chunk_text FROM retrieved_chunks GROUP BY 1)"
