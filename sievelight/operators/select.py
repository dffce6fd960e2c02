"""Order-dependent selection over many queries at once: de-duplication, budget, coverage swaps, sufficiency.

The groups of a query may be large; each step first cuts a group to the rows that can matter at all, by windows that
Spark prunes early, so that the folds in Python see a bounded number of rows. The cuts are exact, see each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..runtime import exists, materialize
from .validate import require


def keep_greedily(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The nodes (grp, id, prio) that a greedy pass in the order of prio keeps, given symmetric conflicts (grp, a, b).

    The pass is the lexicographically first maximal independent set: in rounds, nodes without an undecided conflict of
    higher priority are kept and their neighbours dropped. A dropped node suppresses no other, as in the sequential pass.
    """
    e = conflicts.select("grp", F.explode(F.array(F.struct(F.col("a").alias("hi"), F.col("b").alias("lo")), F.struct(F.col("b").alias("hi"), F.col("a").alias("lo")))).alias("e")).select("grp", "e.hi", "e.lo")
    rank = nodes.select("grp", "id", "prio")
    e = e.join(rank.select("grp", F.col("id").alias("hi"), F.col("prio").alias("ph")), ["grp", "hi"]).join(rank.select("grp", F.col("id").alias("lo"), F.col("prio").alias("pl")), ["grp", "lo"])
    edges = materialize(e.filter("ph < pl").select("grp", "hi", "lo").distinct(), "conflicts")
    touched = edges.select("grp", F.explode(F.array("hi", "lo")).alias("id")).distinct()
    kept = nodes.join(touched, ["grp", "id"], "left_anti").select("grp", "id")
    undecided, live = materialize(touched, "undecided"), edges
    while exists(undecided):
        blocked = live.select("grp", F.col("lo").alias("id")).distinct()
        now = materialize(undecided.join(blocked, ["grp", "id"], "left_anti"), "kept")
        gone = live.join(now.select("grp", F.col("id").alias("hi")), ["grp", "hi"], "left_semi").select("grp", F.col("lo").alias("id"))
        out = now.unionByName(gone).distinct()
        kept = kept.unionByName(now)
        undecided = materialize(undecided.join(out, ["grp", "id"], "left_anti"), "undecided")
        live = materialize(live.join(out.withColumnRenamed("id", "hi"), ["grp", "hi"], "left_anti").join(out.withColumnRenamed("id", "lo"), ["grp", "lo"], "left_anti"), "live")
    return kept


def budget_of(query_type: Column) -> Column:
    return F.coalesce(*[F.when(query_type == k, F.lit(v)) for k, v in C.TOKEN_BUDGET.items()])


SENTENCE = "query_id string, sentence_id string, token_count int, score double, is_bridge boolean"


def fit_budget(sentences: DataFrame, types: DataFrame) -> DataFrame:
    """Adds budget and selected: bridges first, then by score, each taken if it still fits, else skipped.

    sentences has SENTENCE, one row for each sentence; queries of an unknown type have no budget and are left out.
    A sentence without tokens always fits and takes nothing. What remains never grows, so of the sentences of one length only the first budget / length can be taken: the rest are
    cut off before the fold, which then sees at most budget * ln(budget) rows.
    """
    require(sentences, {"query_id": "string", "sentence_id": "string", "token_count": "int", "score": "double", "is_bridge": "boolean"}, "the table of sentences")
    rows = sentences.join(types.select("query_id", budget_of(F.col("query_type")).alias("budget")), "query_id").filter("budget IS NOT NULL")
    order = [F.col("is_bridge").desc(), F.col("score").desc(), F.col("sentence_id")]
    ranked = rows.withColumn("__rn", F.row_number().over(W.partitionBy("query_id", "token_count").orderBy(*order)))
    can = ranked.filter((F.col("token_count") > 0) & (F.col("__rn") * F.col("token_count") <= F.col("budget")))

    # the fold stays in the JVM: an array in the order of the pass, with what is left and what was taken as its state
    item = F.struct((~F.col("is_bridge")).alias("b"), (-F.col("score")).alias("s"), "sentence_id", "token_count")
    lists = can.groupBy("query_id").agg(F.max("budget").alias("budget"), F.array_sort(F.collect_list(item)).alias("items"))
    state = F.struct(F.col("budget").cast("bigint").alias("left"), F.array().cast("array<string>").alias("taken"))

    def take(acc: Column, x: Column) -> Column:
        return F.when(x["token_count"] <= acc["left"], F.struct((acc["left"] - x["token_count"]).alias("left"), F.array_append(acc["taken"], x["sentence_id"]).alias("taken"))).otherwise(acc)

    picked = lists.select("query_id", F.explode(F.aggregate("items", state, take, lambda acc: acc["taken"])).alias("sentence_id"))
    return rows.join(picked.withColumn("selected", F.lit(True)), ["query_id", "sentence_id"], "left").withColumn("selected", F.coalesce("selected", F.col("token_count") <= 0))


def budget_stats(filled: DataFrame) -> DataFrame:
    s = F.col("selected")
    used = F.sum(F.when(s, F.col("token_count")).otherwise(0)).cast("bigint")
    out = filled.groupBy("query_id").agg(
        F.max("budget").alias("budget"), used.alias("tokens_used"), F.count("*").alias("n_input"), F.count_if(s).alias("n_selected"),
        F.count_if(s & F.col("is_bridge")).alias("bridge_selected"), F.count_if(s & ~F.col("is_bridge")).alias("non_bridge_selected"),
    )
    return out.withColumn("tokens_remaining", (F.col("budget") - F.col("tokens_used")).cast("bigint"))


def with_masks(sentences: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds emask and kmask, one character for each distinct entity and keyword of the query (1 where the sentence covers it), and the sorted terms.

    Token sets are made before the join, once for a sentence and once for a term of a query.
    """
    none = F.array().cast("array<string>")
    terms = queries.select("query_id", F.array_sort(F.array_distinct(F.coalesce("entities", none))).alias("entities"), F.array_sort(F.array_distinct(F.coalesce("keywords", none))).alias("keywords"))
    terms = terms.select("*", *[F.transform(k, T.term_tokens).alias(f"__{k}") for k in ("entities", "keywords")])
    rows = sentences.withColumn("__tokens", T.term_tokens(F.col("text"))).join(terms, "query_id")
    mask = lambda k: F.array_join(F.transform(f"__{k}", lambda t: F.when(T.covers(F.col("__tokens"), t), "1").otherwise("0")), "")
    return rows.withColumn("emask", mask("entities")).withColumn("kmask", mask("keywords")).drop("__tokens", "__entities", "__keywords")


def _by_query(batches: Iterator[pa.RecordBatch], fold: Callable[[list[dict]], list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Applies a fold to the rows of each query; batches come in the order of query_id, the last query of one may go on in the next."""
    held: list[dict] = []
    for batch in batches:
        groups = [list(group) for _, group in groupby([*held, *batch.to_pylist()], key=lambda r: r["query_id"])]
        held = groups.pop() if groups else []
        done = [r for g in groups for r in fold(g)]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if held:
        yield pa.RecordBatch.from_pylist(fold(held), schema)


def fold_queries(df: DataFrame, fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Rows of a query (a bounded number) to result rows; one shuffle by query, many queries in a task."""
    arrow = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")])
    return df.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lambda it: _by_query(it, fold, arrow), schema)


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


#: What the steps after the budget read.
MASKED = {
    "query_id": "string", "sentence_id": "string", "selected": "boolean", "is_bridge": "boolean", "score": "double", "n_chars": "int", "doc_id": "string", "position": "int",
    "emask": "string", "kmask": "string", "entities": "array<string>", "keywords": "array<string>",
}


def _bits(mask: str) -> int:
    return int(mask, 2) if mask else 0


def _best_swap(chosen: list[dict], rest: list[dict]) -> tuple[tuple, dict, dict] | None:
    """(key, removed, added) of the swap that covers most terms more, ties in the order of the key; None where none covers more."""
    have = _union(chosen)
    pool = [r for r in chosen if not r["is_bridge"]] or chosen
    able = [(n, c) for c in rest if (n := (c["bits"] & ~have).bit_count())]
    if not able or not pool:
        return None
    ahead, behind = [0], [0]  # unions of all before and after each of the selection
    for r, s in zip(chosen, reversed(chosen)):
        ahead.append(ahead[-1] | r["bits"])
        behind.append(behind[-1] | s["bits"])
    others = {id(r): ahead[k] | behind[len(chosen) - 1 - k] for k, r in enumerate(chosen)}
    best = None
    for out in pool:
        for n, c in able:
            gain = (others[id(out)] | c["bits"]).bit_count() - have.bit_count()
            if gain > 0:
                key = (-gain, -n, not c["is_bridge"], -c["score"], c["n_chars"], c["doc_id"], c["position"], c["sentence_id"], out["doc_id"], out["position"], out["sentence_id"])
                if best is None or key < best[0]:
                    best = (key, out, c)
    return best


def _split(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    for r in rows:
        r["bits"] = _bits(r["emask"] + r["kmask"])
    return [r for r in rows if r["selected"]], [r for r in rows if not r["selected"]]


def _one_swap(rows: list[dict]) -> list[dict]:
    best = _best_swap(*_split(rows))
    if best is None:
        return []
    key, out, c = best
    return [{"query_id": c["query_id"], "added": c["sentence_id"], "removed": out["sentence_id"], "improvement": -key[0], "n_missing": -key[1]}]


def _swaps(rows: list[dict]) -> list[dict]:
    """Best strictly improving swap, again and again."""
    chosen, rest = _split(rows)
    swaps = 0
    while best := _best_swap(chosen, rest):
        _, out, c = best
        chosen = [r for r in chosen if r is not out] + [c]
        rest = [r for r in rest if r is not c] + [out]
        swaps += 1
    ids = {r["sentence_id"] for r in chosen}
    return [{"query_id": r["query_id"], "sentence_id": r["sentence_id"], "selected": r["sentence_id"] in ids, "swaps": swaps} for r in rows]


def _covered(r: dict) -> list[str]:
    return [t for t, b in zip([*r["entities"], *r["keywords"]], r["emask"] + r["kmask"]) if b == "1"]


def _union(rows: list[dict]) -> int:
    out = 0
    for r in rows:
        out |= r["bits"]
    return out


def swap_for_coverage(masked: DataFrame) -> DataFrame:
    """(query_id, sentence_id, selected, swaps) after the coverage swaps, for the rows that took part; others keep their place."""
    return fold_queries(_swappable(masked), _swaps, "query_id string, sentence_id string, selected boolean, swaps int")


def best_swap(masked: DataFrame) -> DataFrame:
    """(query_id, added, removed, improvement, n_missing): the first swap of each query that has one."""
    return fold_queries(_swappable(masked), _one_swap, "query_id string, added string, removed string, improvement int, n_missing int")


def _swappable(masked: DataFrame) -> DataFrame:
    """The rows that can take part in the coverage swaps.

    masked has selected, is_bridge, score, n_chars, doc_id, position and the masks. Each swap covers at least one term
    more, so there are at most as many swaps as terms, and of the candidates with one mask only the first that many in
    the order of the swaps can come in: the rest are cut off first. Candidates that cover nothing never come in.
    """
    require(masked, MASKED, "the filled budget")
    n_terms = F.size("entities") + F.size("keywords")
    # only queries whose candidates cover a term that the selection lacks can change at all (beyond 62 terms all are tried)
    bits = F.when(n_terms <= 62, F.conv(F.concat("emask", "kmask"), 2, 10).cast("bigint"))
    have = masked.select("query_id", "selected", bits.alias("bits")).groupBy("query_id").agg(F.bit_or("bits").alias("all"), F.bit_or(F.when(F.col("selected"), F.col("bits"))).alias("own"))
    open_ = have.filter(F.col("all").isNull() | (F.col("all").bitwiseAND(F.bitwise_not(F.coalesce("own", F.lit(0)))) != 0)).select("query_id")
    order = [F.col("is_bridge").desc(), F.col("score").desc(), "n_chars", "doc_id", "position", "sentence_id"]
    rank = F.row_number().over(W.partitionBy("query_id", "selected", "emask", "kmask").orderBy(*order))
    some = masked.join(open_, "query_id", "left_semi").withColumn("__rn", rank).filter(F.col("selected") | (F.concat("emask", "kmask").contains("1") & (F.col("__rn") <= n_terms))).drop("__rn")
    columns = ["query_id", "sentence_id", "selected", "is_bridge", "score", "n_chars", "doc_id", "position", "emask", "kmask", "entities", "keywords"]
    return some.select(*columns)


def coverage(masked: DataFrame, selected_only: bool = True) -> DataFrame:
    """(query_id, n_entities, covered_entities, n_keywords, covered_keywords, missing_entities, missing_keywords) of the selection."""
    rows = masked.filter("selected") if selected_only else masked
    terms = masked.groupBy("query_id").agg(F.first("entities").alias("entities"), F.first("keywords").alias("keywords"))

    def covered(kind: str, mask: str) -> DataFrame:
        e = rows.select("query_id", F.explode(F.arrays_zip(F.col(kind).alias("t"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(mask), F.lit(1))), lambda i: F.substring(F.col(mask), i, F.lit(1))).alias("m"))).alias("z"))
        return e.filter("z.m = '1' AND z.t IS NOT NULL").groupBy("query_id").agg(F.collect_set("z.t").alias(f"c_{kind}"))

    out = terms.join(covered("entities", "emask"), "query_id", "left").join(covered("keywords", "kmask"), "query_id", "left")
    none = F.array().cast("array<string>")
    for kind in ("entities", "keywords"):
        out = out.withColumn(f"c_{kind}", F.coalesce(f"c_{kind}", none)).withColumn(f"missing_{kind}", F.array_sort(F.array_except(kind, f"c_{kind}")))
    return out.select("query_id", *[c for kind in ("entities", "keywords") for c in (F.size(kind).alias(f"n_{kind}"), F.size(f"c_{kind}").alias(f"covered_{kind}"), F.col(f"missing_{kind}"))])


def required_evidence(query_type: Column, complexity: Column) -> Column:
    base = F.coalesce(*[F.when(query_type == k, F.lit(v)) for k, v in C.MINIMUM_EVIDENCE.items()], F.lit(C.DEFAULT_MINIMUM))
    return base + F.coalesce(*[F.when(complexity == k, F.lit(v)) for k, v in C.COMPLEXITY_BUMP.items()], F.lit(0))


def _expand(rows: list[dict]) -> list[dict]:
    head = rows[0]
    chosen, rest = [r for r in rows if r["selected"]], [r for r in rows if not r["selected"]]
    every = [*head["entities"], *head["keywords"]]
    done = {t for r in chosen for t in _covered(r)}
    missing_e, missing_k = set(head["entities"]) - done, set(head["keywords"]) - done
    need_bridge = head["query_type"] == "multi_hop"
    bridge = any(r["is_bridge"] for r in chosen) or not need_bridge
    limit = C.MAX_EXPANSION.get(head["query_type"], C.DEFAULT_EXPANSION)
    count, added, reason = head["n_selected"], [], "sufficient"
    while not (not missing_e and not missing_k and count >= head["required"] and bridge):
        if len(added) >= limit:
            reason = "expansion_limit"
            break
        if not rest:
            reason = "no_useful_candidates"
            break
        key = lambda r: (not missing_e & set(_covered(r)), not missing_k & set(_covered(r)), not (need_bridge and r["is_bridge"]), -r["score"], r["n_chars"], r["doc_id"], r["position"], r["sentence_id"])
        best = min(rest, key=key)
        rest = [r for r in rest if r is not best]
        added.append(best["sentence_id"])
        count += 1
        missing_e -= set(_covered(best))
        missing_k -= set(_covered(best))
        bridge = bridge or best["is_bridge"]
    complete = not missing_e and not missing_k
    return [{
        "query_id": head["query_id"], "sufficient": complete and count >= head["required"] and bridge, "coverage_complete": complete, "minimum_met": count >= head["required"], "bridge_met": bridge,
        "complexity": head["complexity"], "required": head["required"], "n_selected": count, "n_added": len(added), "expansion_limit": limit, "added": added, "stopped": reason, "n_terms": len(every),
    }]


EXPANDED = "query_id string, sufficient boolean, coverage_complete boolean, minimum_met boolean, bridge_met boolean, complexity string, required int, n_selected int, n_added int, expansion_limit int, added array<string>, stopped string, n_terms int"


def expand(masked: DataFrame, queries: DataFrame) -> DataFrame:
    """Sufficiency of each query's selection, after adding up to the allowed number of candidates, best first.

    masked as for the swaps, queries has query_type and complexity. At most max(MAX_EXPANSION) rows are added, so of the
    candidates alike in masks and bridge flag only the first that many can be: the rest are cut off first; of the
    selection one row for each mask and bridge flag tells what it covers.
    """
    require(masked, MASKED, "the filled budget")
    require(queries, {"query_id": "string", "query_type": "string", "complexity": "string"}, "the table of questions")
    most = max(*C.MAX_EXPANSION.values(), C.DEFAULT_EXPANSION)
    sizes = masked.groupBy("query_id").agg(F.count_if("selected").cast("int").alias("n_selected"))
    rank = F.row_number().over(W.partitionBy("query_id", "selected", "is_bridge", "emask", "kmask").orderBy(F.col("score").desc(), "n_chars", "doc_id", "position", "sentence_id"))
    some = masked.withColumn("__rn", rank).filter(F.col("__rn") <= F.when(F.col("selected"), 1).otherwise(most)).drop("__rn", "query_type")
    q = queries.select("query_id", F.coalesce("query_type", F.lit("")).alias("query_type"), "complexity", required_evidence(F.col("query_type"), F.col("complexity")).alias("required"))
    columns = ["query_id", "sentence_id", "selected", "is_bridge", "score", "n_chars", "doc_id", "position", "emask", "kmask", "entities", "keywords", "query_type", "complexity", "required", "n_selected"]
    return some.join(q, "query_id").join(sizes, "query_id").select(*columns).transform(lambda d: fold_queries(d, _expand, EXPANDED))
