"""Order-dependent selection against plain sequential versions on random inputs."""

import random

from sievelight.operators import graph, select


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_greedy_keeps_what_a_sequential_pass_keeps(spark):
    rng = random.Random(3)
    nodes, conflicts = [], []
    for g in ("p", "q", "r"):
        n = rng.randint(1, 25)
        prio = rng.sample(range(100), n)
        nodes += [(g, f"{i:02d}", prio[i]) for i in range(n)]
        conflicts += [(g, f"{i:02d}", f"{j:02d}") for i in range(n) for j in range(i + 1, n) if rng.random() < 0.25]
    got = {(r.grp, r.id) for r in select.keep_greedily(frame(spark, nodes, "grp string, id string, prio int"), frame(spark, conflicts, "grp string, a string, b string")).collect()}
    bad = {(g, a, b) for g, a, b in conflicts} | {(g, b, a) for g, a, b in conflicts}
    want = set()
    for g, i, _ in sorted(nodes, key=lambda x: x[2]):
        if not any((g, i, k) in bad for h, k in want if h == g):
            want.add((g, i))
    assert got == want


def sequential_fill(rows, budget):
    left, out = budget, set()
    for sid, n, s, b in sorted(rows, key=lambda r: (not r[3], -r[2], r[0])):
        if n <= left:
            out.add(sid)
            left -= n
    return out


def test_budget_equals_the_uncut_fold(spark):
    rng = random.Random(5)
    types = [("a", "factoid"), ("b", "descriptive"), ("c", "multi_hop"), ("d", "odd"), ("e", None)]
    rows = [(q, f"{q}{i:03d}", rng.choice([0, 1, 3, 40, 90, 200, 401]), rng.choice([0.1, 0.5, rng.random()]), rng.random() < 0.2) for q, _ in types for i in range(rng.randint(1, 120))]
    out = select.fit_budget(frame(spark, rows, select.SENTENCE), frame(spark, types, "query_id string, query_type string")).collect()
    got = {(r.query_id, r.sentence_id) for r in out if r.selected}
    budgets = {"a": 400, "b": 700, "c": 1000}
    assert got == {(q, s) for q, limit in budgets.items() for s in sequential_fill([r[1:] for r in rows if r[0] == q], limit)}
    assert {r.query_id for r in out} == set(budgets)


def covers(text, term):
    return bool(term) and set(term.split()) <= set(text.split())


def sequential_swaps(rows, terms):
    chosen, rest = [r for r in rows if r["selected"]], [r for r in rows if not r["selected"]]
    cov = lambda s, kind: {t for t in terms[kind] if any(covers(r["text"], t) for r in s)}
    score = lambda s: len(cov(s, "e")) + len(cov(s, "k"))
    while True:
        missing = (set(terms["e"]) | set(terms["k"])) - cov(chosen, "e") - cov(chosen, "k")
        pool = [r for r in chosen if not r["is_bridge"]] or chosen
        best = None
        for c in rest:
            n = sum(covers(c["text"], t) for t in missing)
            for out in pool if n else []:
                gain = score([r for r in chosen if r is not out] + [c]) - score(chosen)
                if gain > 0:
                    key = (-gain, -n, not c["is_bridge"], -c["score"], len(c["text"]), c["doc_id"], c["position"], c["sentence_id"], out["doc_id"], out["position"], out["sentence_id"])
                    if best is None or key < best[0]:
                        best = (key, out, c)
        if best is None:
            return {r["sentence_id"] for r in chosen}
        chosen = [r for r in chosen if r is not best[1]] + [best[2]]
        rest = [r for r in rest if r is not best[2]] + [best[1]]


def make(spark, seed):
    rng = random.Random(seed)
    words = ["iron", "mill", "tower", "guild", "copper", "lake"]
    queries, rows = [], []
    for q in "abcde":
        terms = {"e": rng.sample(words, 2), "k": rng.sample(words, 3)}
        queries.append((q, terms["e"], terms["k"], rng.choice(["factoid", "multi_hop", "descriptive"])))
        rows += [dict(query_id=q, sentence_id=f"{q}{i:02d}", text=" ".join(rng.choice([*words, "and", "old"]) for _ in range(rng.randint(1, 4))), doc_id=rng.choice("xy"), position=i, score=rng.choice([0.5, rng.random()]), is_bridge=rng.random() < 0.3, selected=rng.random() < 0.3) for i in range(24)]
    df = frame(spark, [tuple(r.values()) for r in rows], "query_id string, sentence_id string, text string, doc_id string, position int, score double, is_bridge boolean, selected boolean")
    q = frame(spark, queries, "query_id string, entities array<string>, keywords array<string>, query_type string")
    return rows, queries, df.selectExpr("*", "length(text) AS n_chars"), q


def test_swaps_equal_the_uncut_loop(spark):
    rows, queries, df, q = make(spark, 8)
    got = {}
    for r in select.swap_for_coverage(select.with_masks(df, q)).collect():
        got.setdefault(r.query_id, set()).update([r.sentence_id] if r.selected else [])
    for name, e, k, _ in queries:
        own = [r for r in rows if r["query_id"] == name]
        assert got.get(name, {r["sentence_id"] for r in own if r["selected"]}) == sequential_swaps(own, {"e": e, "k": k})


def sequential_expand(rows, e, k, kind, required):
    from sievelight import config as C

    chosen, rest = [r for r in rows if r["selected"]], [r for r in rows if not r["selected"]]
    me, mk = ({t for t in terms if not any(covers(r["text"], t) for r in chosen)} for terms in (e, k))
    bridge, added = kind != "multi_hop" or any(r["is_bridge"] for r in chosen), []
    while True:
        if not me and not mk and len(chosen) >= required and bridge:
            return added, "sufficient"
        if len(added) >= C.MAX_EXPANSION[kind]:
            return added, "expansion_limit"
        if not rest:
            return added, "no_useful_candidates"
        hit = lambda r, terms: any(covers(r["text"], t) for t in terms)
        best = min(rest, key=lambda r: (not hit(r, me), not hit(r, mk), not (kind == "multi_hop" and r["is_bridge"]), -r["score"], len(r["text"]), r["doc_id"], r["position"], r["sentence_id"]))
        rest.remove(best)
        chosen.append(best)
        added.append(best["sentence_id"])
        me, mk = ({t for t in terms if not covers(best["text"], t)} for terms in (me, mk))
        bridge = bridge or best["is_bridge"]


def test_expansion_equals_the_uncut_loop(spark):
    rows, queries, df, q = make(spark, 9)
    got = {r.query_id: r for r in select.expand(select.with_masks(df, q), q.selectExpr("query_id", "query_type", "'high' AS complexity")).collect()}
    for name, e, k, kind in queries:
        own = [r for r in rows if r["query_id"] == name]
        if not any(r["selected"] for r in own):
            continue
        added, reason = sequential_expand(list(own), set(e), set(k), kind, {"factoid": 2, "descriptive": 4, "multi_hop": 6}[kind] + 1)
        assert (got[name].added, got[name].stopped) == (added, reason)


def sequential_bridges(incident, sources):
    nodes = {n for n, _ in incident}
    cs = {n: {c for m, c in incident if m == n} for n in nodes}
    out = {}
    for s in sources:
        seen, queue = {s}, [[s]]
        while queue:
            path = queue.pop(0)
            if path[-1] in sources and path[-1] != s:
                out[s] = path
                break
            for n in sorted(nodes):
                if n not in seen and cs[n] & cs[path[-1]]:
                    seen.add(n)
                    queue.append([*path, n])
    return out


def test_bridges_equal_breadth_first_search(spark):
    rng = random.Random(11)
    incident, sources, want = [], [], {}
    for g in ("p", "q", "r", "s"):
        inc = {(n, rng.randrange(12)) for n in range(14) for _ in range(rng.choice([1, 1, 2]))}
        src = set(rng.sample(sorted({n for n, _ in inc}), 3))
        want |= {(g, s): p for s, p in sequential_bridges(inc, src).items()}
        incident += [(g, n, f"c{c}") for n, c in inc]
        sources += [(g, n) for n in src]
    paths = graph.bridges(frame(spark, incident, "grp string, node int, concept string"), frame(spark, sources, "grp string, node int"))
    assert {(r.grp, r.src): r.path for r in paths.collect()} == want
