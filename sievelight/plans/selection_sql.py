"""SQL of the selection steps that depend on their own results: bridges, coverage swaps, expansion. Loops are recursive."""

from __future__ import annotations

from .. import config as C
from ..operators.analyze import FUNCTION_WORDS
from . import sqltext as S

_CONCEPTS = rf"""list_distinct(list_filter(list_concat(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '^\S+', ''), '[A-Z][A-Za-z0-9]+'), lambda x: lower(x)),
  {S.lemmas("regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}')")}), lambda w: NOT list_contains({S.listed(FUNCTION_WORDS)}, w)))"""


def cosine_edges(valid: str) -> str:
    """close: pairs by the stored embeddings; valid defines v, the sentences with a usable one."""
    return f"""{valid}, close AS MATERIALIZED (SELECT a.query_id AS grp, a.sentence_id AS u, b.sentence_id AS v FROM v a JOIN v b ON a.query_id = b.query_id AND a.sentence_id < b.sentence_id WHERE {S.cosine('a.embedding', 'b.embedding')} >= {C.GRAPH_COSINE})"""


def graph(close: str, rows: str = S.ONE_SENTENCE) -> str:
    """inc, shared and cosine edges, the terms of the questions and the source sentences of rows; close defines the cosine edges (grp, u, v)."""
    return f"""{close},
one AS MATERIALIZED (SELECT query_id AS grp, sentence_id AS node, text FROM {rows}),
inc AS MATERIALIZED (SELECT grp, node, unnest({_CONCEPTS}) AS concept FROM one),
shared AS MATERIALIZED (SELECT DISTINCT a.grp, a.node AS u, b.node AS v FROM inc a JOIN inc b ON a.grp = b.grp AND a.concept = b.concept AND a.node < b.node),
asked AS (SELECT query_id AS grp, lower(trim(unnest(list_concat(coalesce(entities, []), coalesce(keywords, []))), ' ')) AS concept FROM queries),
own AS (SELECT query_id AS grp, unnest({_CONCEPTS.replace("text", "query")}) AS concept FROM queries),
wanted AS (SELECT DISTINCT grp, concept FROM asked WHERE concept <> '' UNION SELECT grp, concept FROM own WHERE grp NOT IN (SELECT grp FROM asked WHERE concept <> '')),
source AS MATERIALIZED (SELECT DISTINCT grp, node FROM inc JOIN wanted USING (grp, concept))"""


def bridges(close: str, rows: str = S.ONE_SENTENCE) -> str:
    """walk: breadth-first search from every source at once; a row holds the frontier and what was seen, the last one of a source its path."""
    return f"""{graph(close, rows)},
edge AS MATERIALIZED (SELECT grp, u, v FROM shared UNION SELECT grp, v, u FROM shared UNION SELECT grp, u, v FROM close UNION SELECT grp, v, u FROM close),
walk AS (
  SELECT grp, node AS src, [{{'n': node, 'p': [node]}}] AS front, [node] AS seen, NULL::VARCHAR[] AS path FROM source
  UNION ALL
  SELECT grp, src, list({{'n': v, 'p': list_append(p, v)}}), list_concat(any_value(seen), list(v)), min(list_append(p, v)) FILTER (ends)
  FROM (SELECT w.grp, w.src, any_value(w.seen) AS seen, e.v, min(w.f.p) AS p, bool_or(s.node IS NOT NULL) AS ends
        FROM (SELECT grp, src, seen, unnest(front) AS f FROM walk WHERE path IS NULL) w JOIN edge e ON e.grp = w.grp AND e.u = w.f.n LEFT JOIN source s ON s.grp = e.grp AND s.node = e.v
        WHERE NOT list_contains(w.seen, e.v) GROUP BY w.grp, w.src, e.v)
  GROUP BY grp, src)"""


def bridge_nodes(close: str) -> str:
    return f"WITH RECURSIVE {bridges(close)} SELECT DISTINCT grp AS query_id, unnest(path) AS sentence_id FROM walk WHERE path IS NOT NULL"


def masked(budget: str) -> str:
    """m: every sentence with a budget, whether it is selected, and the terms it covers as bits; budget defines r and f."""
    return f"""{budget},
term AS MATERIALIZED (SELECT *, {S.term_set('term')} AS tt, row_number() OVER (PARTITION BY query_id ORDER BY kind, term) - 1 AS pos
  FROM (SELECT DISTINCT query_id, 'e' AS kind, unnest(entities) AS term FROM queries UNION SELECT DISTINCT query_id, 'k', unnest(keywords) FROM queries)),
full_of AS (SELECT query_id, sum(1::BIGINT << pos)::BIGINT AS every, sum(CASE WHEN kind = 'e' THEN 1::BIGINT << pos ELSE 0 END)::BIGINT AS ents, count(*) AS n_terms FROM term GROUP BY 1),
said AS MATERIALIZED (SELECT query_id, sentence_id, text, doc_id, position, {S.term_set('text')} AS tok FROM {S.ONE_SENTENCE}),
cover AS (SELECT s.query_id, s.sentence_id, sum(1::BIGINT << pos)::BIGINT AS bits FROM said s JOIN term t ON t.query_id = s.query_id AND len(tt) > 0 AND list_has_all(tok, tt) GROUP BY 1, 2),
m AS MATERIALIZED (SELECT r.query_id, r.sentence_id, f.selected, r.br, r.score, length(s.text) AS n_chars, s.doc_id, s.position, coalesce(c.bits, 0) AS bits
  FROM r JOIN f ON f.query_id = r.query_id AND f.k = r.k JOIN said s ON s.sentence_id = r.sentence_id LEFT JOIN cover c ON c.sentence_id = r.sentence_id)"""


_ORDER = "c.br DESC, c.score DESC, c.n_chars, c.doc_id, c.position, c.sentence_id, o.doc_id, o.position, o.sentence_id"


def pairs(state: str) -> str:
    """Strictly improving swaps of the selections `sel` of a relation, ranked for each query."""
    return f"""(
    WITH x AS (SELECT t.query_id, t.sel, t.swaps, m.* EXCLUDE (query_id) FROM (SELECT query_id, sel, swaps, unnest(sel) AS id FROM {state}) t JOIN m ON m.query_id = t.query_id AND m.sentence_id = t.id),
    have AS (SELECT query_id, any_value(sel) AS sel, any_value(swaps) AS swaps, bit_or(bits) AS bits, bool_or(NOT br) AS plain FROM x GROUP BY 1),
    pool AS (SELECT x.query_id, x.sentence_id, x.doc_id, x.position, coalesce(bit_or(y.bits), 0) AS others FROM x JOIN have h USING (query_id) LEFT JOIN x y ON y.query_id = x.query_id AND y.sentence_id <> x.sentence_id
             WHERE NOT x.br OR NOT h.plain GROUP BY 1, 2, 3, 4)
    SELECT h.query_id, h.sel, h.swaps, c.sentence_id AS cand, o.sentence_id AS removed, bit_count(o.others | c.bits) - bit_count(h.bits) AS gain, bit_count(c.bits & ~h.bits) AS n_missing,
      row_number() OVER (PARTITION BY h.query_id ORDER BY bit_count(o.others | c.bits) - bit_count(h.bits) DESC, bit_count(c.bits & ~h.bits) DESC, {_ORDER}) AS rn
    FROM have h JOIN pool o ON o.query_id = h.query_id JOIN m c ON c.query_id = h.query_id AND NOT list_contains(h.sel, c.sentence_id)
    WHERE c.bits & ~h.bits <> 0 AND bit_count(o.others | c.bits) > bit_count(h.bits))"""


_START = "SELECT query_id, 0 AS swaps, coalesce(list(sentence_id) FILTER (selected), []) AS sel FROM m GROUP BY 1"


def swapped(budget: str) -> str:
    """last: the selection of each query after all swaps, and their number."""
    return f"""{masked(budget)},
swap AS ({_START} UNION ALL SELECT query_id, swaps + 1, list_append(list_filter(sel, lambda i: i <> removed), cand) FROM {pairs('swap')} WHERE rn = 1),
last AS MATERIALIZED (SELECT query_id, max(swaps) AS swaps, arg_max(sel, swaps) AS sel FROM swap GROUP BY 1)"""


def best_swap(budget: str) -> str:
    return f"WITH RECURSIVE {masked(budget)}, start AS ({_START}) SELECT query_id, cand AS added, removed, CAST(gain AS INT) AS improvement, CAST(n_missing AS INT) AS n_missing FROM {pairs('start')} WHERE rn = 1"


def swap_loop(budget: str) -> str:
    return f"WITH RECURSIVE {swapped(budget)} SELECT m.query_id, m.sentence_id, NOT m.selected AS after, CAST(l.swaps AS INT) AS swaps FROM m JOIN last l USING (query_id) WHERE m.selected <> list_contains(l.sel, m.sentence_id)"


def diversity_stats(budget: str) -> str:
    def missing(kind: str) -> str:
        return f"coalesce(string_agg(t.term, '|' ORDER BY t.term) FILTER (WHERE t.kind = '{kind}' AND (g.bits >> t.pos) & 1 = 0), '')"

    return f"""
WITH RECURSIVE {swapped(budget)},
g AS (SELECT l.query_id, any_value(l.swaps) AS swaps, coalesce(bit_or(m.bits) FILTER (list_contains(l.sel, m.sentence_id)), 0) AS bits, coalesce(bit_or(m.bits) FILTER (m.selected), 0) AS before FROM last l JOIN m USING (query_id) GROUP BY 1),
h AS (SELECT g.query_id, g.swaps, bit_count(g.bits & coalesce(ents, 0)) AS ce, bit_count(g.bits & ~coalesce(ents, 0)) AS ck, bit_count(g.before) AS cb, bit_count(g.bits) AS ca, {missing('e')} AS me, {missing('k')} AS mk
  FROM g LEFT JOIN full_of USING (query_id) LEFT JOIN term t ON t.query_id = g.query_id GROUP BY g.query_id, g.swaps, g.bits, g.before, ents)
SELECT h.query_id, CAST(coalesce(len(q.entities), 0) AS INT) AS query_entities, CAST(ce AS INT) AS covered_entities, CASE WHEN coalesce(len(q.entities), 0) > 0 THEN round(ce / len(q.entities), 6) ELSE 1.0 END AS coverage_ratio, me AS missing_entities,
  CAST(coalesce(len(q.keywords), 0) AS INT) AS query_keywords, CAST(ck AS INT) AS covered_keywords, CASE WHEN coalesce(len(q.keywords), 0) > 0 THEN round(ck / len(q.keywords), 6) ELSE 1.0 END AS keyword_coverage_ratio, mk AS missing_keywords,
  CAST(h.swaps AS INT) AS sentence_swaps, ca > cb AS coverage_improved, CAST(cb AS INT) AS coverage_before, CAST(ca AS INT) AS coverage_after, CAST(ca - cb AS INT) AS coverage_delta
FROM h JOIN queries q USING (query_id)"""


def expanded(budget: str) -> str:
    """z: expansion by the best candidate at a time, until the evidence suffices, the limit is reached or none is left; a query a row."""
    low = f"{S.word_count('query')} <= {C.COMPLEXITY['low'][0]} AND coalesce(len(entities), 0) <= {C.COMPLEXITY['low'][1]} AND coalesce(len(keywords), 0) <= {C.COMPLEXITY['low'][2]}"
    medium = f"{S.word_count('query')} <= {C.COMPLEXITY['medium'][0]} AND coalesce(len(entities), 0) <= {C.COMPLEXITY['medium'][1]} AND coalesce(len(keywords), 0) <= {C.COMPLEXITY['medium'][2]}"
    return f"""{swapped(budget)},
q AS (SELECT *, {S.by_type('query_type', C.MINIMUM_EVIDENCE)} + {S.by_type('complexity', C.COMPLEXITY_BUMP)} AS required, {S.by_type('query_type', C.MAX_EXPANSION)} AS most, query_type = 'multi_hop' AS need
  FROM (SELECT query_id, query_type, CASE WHEN {low} THEN 'low' WHEN {medium} THEN 'medium' ELSE 'high' END AS complexity FROM queries) WHERE query_id IN (SELECT query_id FROM last)),
s0 AS (SELECT l.query_id, l.sel, count(*) FILTER (list_contains(l.sel, m.sentence_id)) AS n, coalesce(bit_or(m.bits) FILTER (list_contains(l.sel, m.sentence_id)), 0) AS bits,
    NOT any_value(q.need) OR coalesce(bool_or(m.br) FILTER (list_contains(l.sel, m.sentence_id)), false) AS bridge FROM last l JOIN m USING (query_id) JOIN q USING (query_id) GROUP BY 1, 2),
s AS (
  SELECT query_id, n, bits, bridge, []::VARCHAR[] AS added FROM s0
  UNION ALL
  SELECT query_id, n + 1, bits | cbits, bridge OR cbr, list_append(added, cand) FROM (
    SELECT s.query_id, s.n, s.bits, s.bridge, s.added, m.sentence_id AS cand, m.bits AS cbits, m.br AS cbr,
      row_number() OVER (PARTITION BY s.query_id ORDER BY (m.bits & ~s.bits & coalesce(ents, 0)) = 0, (m.bits & ~s.bits & ~coalesce(ents, 0)) = 0, NOT (q.need AND m.br), m.score DESC, m.n_chars, m.doc_id, m.position, m.sentence_id) AS rn
    FROM s JOIN q USING (query_id) LEFT JOIN full_of o USING (query_id) JOIN s0 USING (query_id) JOIN m ON m.query_id = s.query_id AND NOT list_contains(s0.sel, m.sentence_id) AND NOT list_contains(s.added, m.sentence_id)
    WHERE NOT (s.bits = coalesce(every, 0) AND s.n >= q.required AND s.bridge) AND len(s.added) < q.most) WHERE rn = 1),
e AS (SELECT query_id, max(n) AS n, arg_max(bits, n) AS bits, arg_max(bridge, n) AS bridge, arg_max(added, n) AS added FROM s GROUP BY 1),
z AS (SELECT e.*, q.*  EXCLUDE (query_id), e.bits = coalesce(every, 0) AS complete, coalesce(n_terms, 0) AS n_terms FROM e JOIN q USING (query_id) LEFT JOIN full_of USING (query_id))"""


def sufficiency(budget: str) -> str:
    return f"""
WITH RECURSIVE {expanded(budget)}
SELECT query_id, complete AND n >= required AND bridge AS sufficient, complete AS coverage_complete, n >= required AS minimum_met, bridge AS bridge_met, complexity, CAST(required AS INT) AS required, CAST(n AS INT) AS n_selected,
  CAST(len(added) AS INT) AS n_added, CAST(most AS INT) AS expansion_limit, array_to_string(added, '|') AS added, CASE WHEN complete AND n >= required AND bridge THEN 'sufficient' WHEN len(added) >= most THEN 'expansion_limit' ELSE 'no_useful_candidates' END AS stopped,
  CAST(n_terms AS INT) AS n_terms FROM z"""


def retrieved(bm25: str, embed) -> str:
    """hit: the fused hits of every question, place by place, `most` of them wanted; the table of questions is shadowed by the analysed ones."""
    types = lambda place: S.by_type("query_type", {k: v[place] for k, v in C.DEPTHS.items()})
    return f"""queries AS (SELECT query_id, query, coalesce(query_type, {S.query_type('query')}) AS query_type, coalesce(entities, {S.entities('query')}) AS entities, coalesce(keywords, {S.keywords('query')}) AS keywords FROM main.queries),
texts AS MATERIALIZED {S.CHUNKS}, meta AS (SELECT chunk_idx, min(doc_id) AS doc_id, min(dataset) AS dataset, min(title) AS title, min(year) AS year FROM retrieved_chunks GROUP BY 1),
{bm25},
{embed('hq', 'query_id', 'query', 'queries')}, {embed('hc', 'chunk_idx', 'chunk_text', 'texts')},
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, CAST(id AS VARCHAR)) AS dr FROM (SELECT hq.id AS query_id, hc.id, round(sum(hq.n * hc.n) / (max(hq.norm) * max(hc.norm)), 9) AS cosine FROM hq JOIN hc USING (bucket) GROUP BY 1, 2) WHERE cosine > 0),
both_ AS (SELECT query_id, id, CASE WHEN rank <= {types(0)} THEN rank END AS sr, CASE WHEN dr <= {types(1)} THEN dr END AS dr, cosine, {types(2)} AS most, query_type, query
  FROM (SELECT coalesce(r.query_id, d.query_id) AS query_id, coalesce(r.id, d.id) AS id, r.rank, d.dr, d.cosine FROM (SELECT * FROM rk WHERE rank <= 30) r FULL OUTER JOIN (SELECT * FROM dense WHERE dr <= 30) d ON d.query_id = r.query_id AND d.id = r.id) JOIN queries USING (query_id)),
hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(1.0::DOUBLE / ({C.RRF_K} + sr), 0.0) + coalesce(1.0::DOUBLE / ({C.RRF_K} + dr), 0.0) DESC, sr NULLS LAST, dr NULLS LAST, id) AS place FROM both_ WHERE sr IS NOT NULL OR dr IS NOT NULL)"""


def scored(bm25: str, embed, evidence: str, share: str, density: str, temporal: str) -> str:
    """kept: the scored sentences of the hits without near copies; their ids carry their question in front, since a sentence may serve several."""
    weights = " + ".join(f"{S.by_type('query_type', {k: w[i] for k, w in C.WEIGHTS.items()})}::DOUBLE * s{i}" for i in range(5))
    return f"""{retrieved(bm25, embed)},
part AS (SELECT chunk_idx, position - 1 AS position, {S.clean('raw')} AS text FROM (SELECT chunk_idx, unnest(p) AS raw, generate_subscripts(p, 1) AS position FROM (SELECT chunk_idx, {S.parts('chunk_text')} AS p FROM texts))),
scored AS MATERIALIZED (SELECT query_id, query_id || '|' || concat_ws(':', dataset, doc_id, chunk_idx, position) AS sentence_id, text, doc_id, position, token_count, floor(({weights}) * 10000 + 0.5000001) / 10000 AS final_score FROM (
  SELECT h.query_id, h.query_type, m.dataset, m.doc_id, p.chunk_idx, p.position, p.text, CAST({S.word_count('p.text')} AS INT) AS token_count,
    CASE WHEN h.dr IS NOT NULL THEN h.cosine ELSE 0.0 END AS s0, {evidence} AS s1, {share} AS s2, {density} AS s3, {temporal} AS s4
  FROM hit h JOIN meta m ON m.chunk_idx = h.id JOIN part p ON p.chunk_idx = h.id WHERE h.place <= h.most AND length(p.text) > 0 AND {S.verdict('p.text')} = 'keep')),
{embed('hs', 'sentence_id', 'text', 'scored')}, hv AS MATERIALIZED (SELECT s.query_id, hs.* FROM hs JOIN scored s ON s.sentence_id = hs.id),
near AS MATERIALIZED (SELECT a.query_id, a.id AS a, b.id AS b, round(sum(a.n * b.n) / (max(a.norm) * max(b.norm)), 9) AS c FROM hv a JOIN hv b ON a.query_id = b.query_id AND a.bucket = b.bucket AND a.id < b.id GROUP BY 1, 2, 3 HAVING c >= {min(C.GRAPH_COSINE, C.DUPLICATE_SOFT)}),
placed AS MATERIALIZED (SELECT query_id, sentence_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, sentence_id) AS k FROM scored),
bad AS (SELECT y.query_id, y.sentence_id, list(x.sentence_id) AS others FROM near JOIN placed x ON x.sentence_id IN (near.a, near.b) JOIN placed y ON y.sentence_id IN (near.a, near.b) AND x.k < y.k WHERE near.c >= {C.DUPLICATE_EXACT} OR near.c >= {C.DUPLICATE_SOFT} AND x.doc_id = y.doc_id GROUP BY 1, 2),
turn AS MATERIALIZED (SELECT p.query_id, p.k, p.sentence_id, coalesce(bad.others, []) AS others FROM placed p LEFT JOIN bad ON bad.sentence_id = p.sentence_id),
pass_ AS (SELECT DISTINCT query_id, 0::BIGINT AS k, []::VARCHAR[] AS done FROM turn UNION ALL SELECT p.query_id, t.k, CASE WHEN list_has_any(p.done, t.others) THEN p.done ELSE list_append(p.done, t.sentence_id) END FROM pass_ p JOIN turn t ON t.query_id = p.query_id AND t.k = p.k + 1),
kept AS MATERIALIZED (SELECT s.* FROM scored s JOIN (SELECT unnest(done) AS sentence_id FROM (SELECT query_id, arg_max(done, k) AS done FROM pass_ GROUP BY 1)) USING (sentence_id))"""


def retrieval_layer(bm25: str, embed) -> str:
    return f"""WITH {retrieved(bm25, embed)}
SELECT query_id, id AS chunk_idx, CAST(place AS INT) AS rrf_rank, round(coalesce(1.0::DOUBLE / ({C.RRF_K} + sr), 0.0) + coalesce(1.0::DOUBLE / ({C.RRF_K} + dr), 0.0), 9) AS rrf_score, sr IS NOT NULL AS sparse, dr IS NOT NULL AS dense FROM hit WHERE place <= most"""


def scoring_layer(*parts) -> str:
    return f"WITH RECURSIVE {scored(*parts)} SELECT query_id, substr(sentence_id, length(query_id) + 2) AS sentence_id, token_count, final_score AS score FROM kept"


def pipeline(budget: str, *parts) -> str:
    """The whole way from questions to evidence; the table of sentences is shadowed by those of the pipeline."""
    close = f"close AS (SELECT query_id AS grp, a AS u, b AS v FROM near WHERE c >= {C.GRAPH_COSINE} AND a IN (SELECT sentence_id FROM kept) AND b IN (SELECT sentence_id FROM kept))"
    return f"""
WITH RECURSIVE {scored(*parts)},
{bridges(close, 'kept')},
sentences AS MATERIALIZED (SELECT *, sentence_id IN (SELECT unnest(path) FROM walk WHERE path IS NOT NULL) AS force_include FROM kept),
{expanded(budget)}
SELECT s.query_id, substr(s.sentence_id, length(s.query_id) + 2) AS sentence_id, s.text, s.token_count, s.final_score AS score, s.force_include AS is_bridge
FROM sentences s JOIN z USING (query_id) JOIN last l USING (query_id) WHERE list_contains(l.sel, s.sentence_id) OR list_contains(z.added, s.sentence_id)"""
