"""Random inputs against small plain-Python models, with hot keys and tiny
task limits so that every split path runs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import link, memory, meter, scale, substring, traverse
from weftgraph.operators.blocks import block_ends


def test_brace_blocks(spark):
    rng = random.Random(1)
    files = {f"f{i}": ["".join(rng.choice("{}{}ab/ ") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 25))] for i in range(60)}
    files["slashes"] = ["fetch('https://x', {", "}", "}"]

    def end(lines, start):
        depth, opened = 0, False
        for i in range(start, len(lines)):
            for ch in re.sub(r"//.*$|/\*.*?\*/", "", lines[i]):
                if ch == "{":
                    depth, opened = depth + 1, True
                elif ch == "}":
                    depth -= 1
                    if opened and depth == 0:
                        return i + 1
        return None

    rows = [("r", f, 0, "ts", n + 1, line, [1]) for f, lines in files.items() for n, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "repo string, file_path string, unit int, lang string, line_no int, line string, starts array<int>")
    got = {(r.file_path, r.start_line): r.block_end for r in block_ends(df).collect()}
    want = {(f, n + 1): end(lines, n) for f, lines in files.items() for n in range(len(lines))}
    assert got == want


def test_salted_join_equals_join(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"))
    small = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, big.join(small, "k", how).select("id", "k").collect()))
        salted = scale.salted_join(big, small, ["k"], how, ["id"], rows_per_task=100)
        assert sorted(map(str, salted.select("id", "k").collect())) == plain, how
        looked = scale.lookup_join(big, small, ["k"], how, ["id"], rows_per_task=100, max_broadcast_rows=3)
        assert sorted(map(str, looked.select("id", "k").collect())) == plain, how


def test_running_before_spans_blocks(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), i, rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = {(r.k, r.o): r.total for r in scale.running_before(df, ["k"], ["o"], {"total": F.col("v")}, blocks=7).collect()}
    sums, want = {}, {}
    for k, o, v in rows:
        want[(k, o)] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    assert got == want


def _guard(calls, limits):
    state, out = {}, {}
    for s, seq, tool, args, tokens, repos, files in sorted(calls, key=lambda c: (c[0], c[1])):
        n, used, sigs, rs, fs = state.setdefault(s, [0, 0, [], set(), set()])
        trigger = ("max_tool_calls" if n >= limits.max_tool_calls else "token_budget_exceeded" if used >= limits.token_budget
                   else "cycle_detected" if sigs.count((tool, args)) >= 2 else "blast_radius_repos" if len(rs) > limits.max_repos
                   else "blast_radius_files" if len(fs) > limits.max_files else None)
        out[(s, seq)] = (trigger, n, used)
        if trigger is None:
            state[s] = [n + 1, used + tokens, sigs + [(tool, args)], rs | set(repos), fs | set(files)]
    return out


def test_guardrails_equal_fold(spark):
    rng = random.Random(3)
    seen = set()
    for limits in (meter.Limits(6, 10_000, 99, 99), meter.Limits(99, 60, 99, 99), meter.Limits(99, 10_000, 3, 99), meter.Limits(99, 10_000, 99, 4), meter.Limits(9, 80, 3, 6)):
        calls = [(0 if rng.random() < 0.4 else rng.randint(1, 12), i, rng.choice("abc"), rng.choice("xy"), rng.randint(0, 20),
                  [f"r{rng.randint(0, 7)}" for _ in range(rng.randint(0, 2))], [f"f{rng.randint(0, 9)}" for _ in range(rng.randint(0, 2))]) for i in range(300)]
        df = spark.createDataFrame(calls, "session int, seq int, tool string, args string, result_tokens int, repos array<string>, files array<string>")
        got = {(r.session, r.seq): (r.trigger, r.calls_before, r.tokens_before) for r in meter.decisions(df, limits).collect()}
        assert got == _guard(calls, limits)
        seen |= {t for t, _, _ in got.values()}
    assert seen == {None, "max_tool_calls", "token_budget_exceeded", "cycle_detected", "blast_radius_repos", "blast_radius_files"}


def test_memory_rounds_equal_one_fold(spark):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 6), i, "user", "w" * rng.randint(0, 300)) for i in range(240)]
    df = spark.createDataFrame(rows, "session long, turn long, role string, text string")
    got = sorted((r.session, r.kind, r.turn, r.step, r.text or "", r.tokens or 0) for r in memory.compact(df, 5, 150, blocks=9).collect())
    folds, want = {}, []
    for s, t, role, text in rows:
        m = folds.setdefault(s, [memory.Memory(5, 150, [], 0), 0])
        want += [(s, "summary", turn, i, made, 0) for i, (turn, made) in enumerate(m[0].add(t, role, text))]
        m[1] = t
    for s, (m, last) in folds.items():
        want += [(s, "window", t, 0, x, 0) for t, _, x in m.kept] + [(s, "counter", last, 0, "", m.tokens)]
    assert got == sorted(want)


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab/_1") for _ in range(rng.randint(0, 14))) for _ in range(150)]
    needles = ["".join(rng.choice("ab/_1") for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["zzzz", "a"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = {tuple(r) for r in substring.contains_join(t, n).select("text_id", "needle").collect()}
    assert got == {(i, x) for i, text in enumerate(texts) for x in set(needles) if x in text}


@pytest.mark.parametrize("how", ["broadcast", "shuffle", "stored", "stored-broadcast"])
def test_blast_radius_with_hub(spark, how):
    rng = random.Random(6)
    pairs = list({(f"n{rng.randint(0, 60)}", "hub" if rng.random() < 0.4 else f"n{rng.randint(0, 60)}") for _ in range(200)})
    ids = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(i, i, "r", f"{i}.py") for i in ids], "id string, symbol_name string, repo string, file_path string")
    edges = spark.createDataFrame(pairs, "caller_id string, callee_id string")
    roots = ["hub", ids[0], ids[5]]
    asked, most = spark.createDataFrame([(r,) for r in roots], "root string"), 500_000 if "broadcast" in how else 0
    if how.startswith("stored"):
        edges = traverse.Adjacency.store(edges, f"arcs_{how.replace('-', '_')}", buckets=3, rows_per_task=5)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        step = edges.wide_step(asked.select(F.col("root").alias("src"), F.lit(1).alias("n")), "upstream")
        plan = step._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert edges.spark.table(f"{edges.name}_upstream_hubs").count()
        lines = plan.splitlines()
        at = next(i for i, line in enumerate(lines) if "SelectedBucketsCount" in line)
        depth, above = re.search(r"\w", lines[at]).start(), []
        for line in reversed(lines[:at]):
            if (m := re.search(r"\w", line)) and m.start() < depth:
                depth = m.start()
                above.append(line)
        assert "SortMergeJoin" in " ".join(above) and not any("Exchange" in x for x in above[: next(i for i, x in enumerate(above) if "SortMergeJoin" in x)])
    walk = traverse.blast_radius(nodes, edges, asked, 3, rows_per_task=5, max_frontier=most)
    got = {(r.root, r.direction, r.node_id): r.depth for r in walk.collect()}
    want = {}
    for root in roots:
        for direction, step in (("upstream", lambda n: {a for a, b in pairs if b == n}), ("downstream", lambda n: {b for a, b in pairs if a == n})):
            level, seen = {root}, {root: 0}
            for depth in (1, 2, 3):
                level = {m for n in level for m in step(n)} - seen.keys()
                seen.update({m: depth for m in level})
            want.update({(root, direction, n): d for n, d in seen.items()})
    assert got == want
    one_way = traverse.blast_radius(nodes, edges, asked, 3, rows_per_task=5, max_frontier=most, directions=("upstream",))
    assert {(r.root, r.direction, r.node_id): r.depth for r in one_way.collect()} == {k: d for k, d in want.items() if k[1] == "upstream"}


def test_route_masks_equal_trie(spark):
    rng = random.Random(7)
    seg = lambda wild: rng.choice(["a", "b", "C"] + ([":x", "{y}", "*"] if wild else ["z"]))
    eps = [(f"e{i}", f"r{rng.randint(0, 3)}", rng.choice(["GET", "POST"]), "/" + "/".join(seg(True) for _ in range(rng.randint(1, 3))), i) for i in range(40)]
    cons = [(f"r{rng.randint(0, 3)}", rng.choice(["GET", "POST"]), "/" + "/".join(seg(False) for _ in range(rng.randint(1, 3)))) for _ in range(150)]
    cons = sorted(set(cons))

    def wild(s):
        return s.startswith(":") or s == "*" or (s[0] == "{" and s[-1] == "}")

    def match(repo, method, route):
        segs, best = route.strip("/").lower().split("/"), None
        for i, r, m, path, o in eps:
            parts = path.strip("/").split("/")
            if r != repo and len(parts) == len(segs) and all(wild(p) or p.lower() == s for p, s in zip(parts, segs)):
                rank = ("".join("1" if wild(p) else "0" for p in parts), m != method, o)
                best = min(best or (rank, i), (rank, i))
        return best and best[1]

    e = spark.createDataFrame(eps, "callee_id string, target_repo string, method string, route string, ordinal int").withColumn("endpoint_route", F.col("route"))
    c = spark.createDataFrame(cons, "caller_repo string, method string, route string")
    got = {(r.caller_repo, r.method, r.route): r.target.callee_id for r in link.parameterised_match(c, e).collect()}
    assert got == {k: match(*k) for k in cons if match(*k)}


def test_ends_of_a_hub_are_the_same_salted(spark, monkeypatch):
    rows = [(f"n{i}", "hub" if i % 3 == 0 else f"n{i % 7}") for i in range(120)] + [("hub", f"n{i}") for i in range(40)] + [("n1", "lost"), (None, "n2")]
    edges = spark.createDataFrame(rows, "caller_id string, callee_id string")
    nodes = spark.createDataFrame([(f"n{i}", f"r{i % 5}") for i in range(110)] + [("hub", "r0")], "id string, repo string")
    ends = [nodes.selectExpr(f"id AS {e}_id", f"repo AS {e}_repo") for e in ("caller", "callee")]
    for how in ("inner", "left"):
        got = []
        for bound in (scale.MAX_BROADCAST_BYTES, -1):
            monkeypatch.setattr(scale, "MAX_BROADCAST_BYTES", bound)
            got.append(sorted(map(str, scale.edges_with_ends(edges, *ends, how, rows_per_task=10).select(
                "caller_id", "callee_id", "caller_repo", "callee_repo").collect())))
        monkeypatch.undo()
        assert got[0] == got[1] and len(got[0]) > 100


def test_vector_index_is_exact_where_certain(spark):
    import numpy as np

    from weftgraph.operators import search
    from weftgraph.operators.vector_index import VectorIndex

    draw = np.random.default_rng(4)
    centers = draw.normal(size=(6, 8))
    rows = [(i, f"r{i % 3}", (centers[i % 6] + draw.normal(scale=0.3, size=8)).tolist()) for i in range(180)]
    rows += [(500, "r1", None), (501, "r2", [0.0] * 8), (502, "r1", [1.0, 2.0]), (503, "r1", rows[7][2]), (504, "lone", rows[9][2])]
    vectors = spark.createDataFrame(rows, "id long, repo string, embedding array<double>")
    asked = [(i, rows[i * 7][2], ("r1", None, "lone", "nowhere")[i % 4]) for i in range(16)] + [(90, None, None), (91, [0.0] * 8, None)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, repo string")
    index = VectorIndex.store(vectors, cells=6)

    def plain(q):
        def cosine(v):
            a, b = np.array(q[1] or [0.0] * 8), np.array(v or [0.0] * 8)
            n = np.sqrt((a * a).sum() * (b * b).sum()) if len(a) == len(b) else 0
            return float(a @ b / n) if n else 0.0

        found = sorted(((-round(cosine(v), 9), i) for i, repo, v in rows if q[2] in (None, repo)))[:5]
        return [(i, -s) for s, i in found]

    for certain in (True, False):
        got = {}
        for r in index.search(queries, 5, probes=2, certain=certain).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, round(r.score, 9) + 0.0))
        assert all(len(got.get(q[0], ())) == len(plain(q)) for q in asked)
        if certain:
            assert {k: v for k, v in got.items()} == {q[0]: plain(q) for q in asked if plain(q)}
    assert index.search(queries.where("false")).count() == 0
    assert VectorIndex.store(vectors.where("false")).search(queries).count() == 0
    # a block without vectors
    few = search.cosine_topk_batch(vectors.limit(1), queries.select("query_id", "embedding"), 3)
    assert few.count() == len(asked)


def test_a_long_lookup_computes_its_stream_once(spark, monkeypatch):
    """Without a broadcast, adaptive execution splits hot keys; the stream is not read again to count them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.range(600).selectExpr("CAST(id % 7 AS STRING) AS caller_id", "CAST(id % 11 AS STRING) AS callee_id").mapInArrow(count, "caller_id string, callee_id string")
    ends = [spark.range(20).selectExpr(f"CAST(id AS STRING) AS {e}_id", f"id AS {e}_at") for e in ("caller", "callee")]
    monkeypatch.setattr(scale, "MAX_BROADCAST_BYTES", -1)
    for how in ("left", "left_semi"):
        before = seen.value
        assert scale.edges_with_ends(edges, *ends, how).count() == 600
        assert seen.value - before == 600, how
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        assert scale.edges_with_ends(edges, *ends, "inner", rows_per_task=10).count() == 600
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def test_edges_of_one_pass_are_those_of_the_view(spark):
    from weftgraph.sources import views

    tables = {
        "nation": spark.createDataFrame([(0, "A"), (1, None)], "n_nationkey int, n_name string"),
        "customer": spark.createDataFrame([(1, 0, "BUILDING"), (2, 1, "X"), (3, None, "X"), (1, 0, "BUILDING"), (None, 0, "X")], "c_custkey int, c_nationkey int, c_mktsegment string"),
        "supplier": spark.createDataFrame([(5, 0), (6, 0), (6, 0), (7, None)], "s_suppkey int, s_nationkey int"),
        "orders": spark.createDataFrame([(10, 1), (11, 2), (12, None), (10, 1), (13, 3)], "o_orderkey int, o_custkey int"),
        "lineitem": spark.createDataFrame([(10, 5, 1, "R"), (10, 5, 2, "A"), (10, 6, 1, None), (11, 6, 1, "R"), (12, 5, None, "R"), (13, 7, 2, "R"), (None, 5, 2, "A")],
                                          "l_orderkey int, l_suppkey int, l_partkey int, l_returnflag string"),
        "part": spark.createDataFrame([(1, "B#1", "T", 3), (2, "B#1", "T", 1), (2, "B#1", "T", 1), (4, None, "T", 2)], "p_partkey int, p_brand string, p_type string, p_size int"),
    }
    one, two = (sorted(map(str, spark.sql(text, **tables).collect())) for text in (views.EDGES, views.EDGES_ONCE))
    assert one == two and len({r.split("edge_type=")[1] for r in one}) == 4
    assert views.EDGES_ONCE.count("{orders}") == 1


def test_searches_alike_are_searched_once(spark, monkeypatch):
    from weftgraph.operators import search

    nodes = spark.createDataFrame([(f"n{i}", f"r{i % 2}", "load", "", "", "read_all of it" if i % 3 else "reads") for i in range(9)],
                                  "id string, repo string, symbol_name string, signature string, docstring string, code_content string")
    asked, whole = [], search.lexical_matches
    monkeypatch.setattr(search, "lexical_matches", lambda index, queries: asked.append(queries.count()) or whole(index, queries))
    rows = [(i, "load" if i % 2 else "read_all", None if i % 3 else "r1") for i in range(5)] + [(50, None, None), (51, "absent", "r0"), (None, "load", "r1")]
    queries = spark.createDataFrame(rows, "query_id int, query string, repo string")
    best = {("load", None): [0, 1, 2], ("load", "r1"): [1, 3, 5], ("read_all", None): [1, 2, 4], ("read_all", "r1"): [1, 5, 7]}
    got = sorted((r.query_id, r.id, r.matched_terms, r.rank) for r in search.lexical_search(nodes, queries, 3).collect())
    assert got == sorted((q, f"n{n}", 1, k) for q, *what in rows[:5] for k, n in enumerate(best[tuple(what)], 1))
    free = {(r.query_id, r.id) for r in search.lexical_search(nodes, queries.drop("repo"), 3).collect()}
    assert free == {(q, f"n{n}") for q, text, _ in rows if (text, None) in best for n in best[text, None]}
    assert asked == [6, 4]


def test_a_walk_carries_numbers_and_gives_ids(spark, monkeypatch):
    """Hops hold a number for each id; ends that are no node, null ends and repeated ids come out as they were."""
    rng = random.Random(5)
    names = [f"n{i}" for i in range(12)]
    nodes = spark.createDataFrame([(n, f"s{i % 5}") for i, n in enumerate(names)] + [("n1", "s1"), (None, "s2"), ("n3", None)], "id string, symbol_name string")
    pairs = [(rng.choice([*names, "x", "y", None]), rng.choice([*names, "x", "z", None])) for _ in range(40)]
    edges = spark.createDataFrame(pairs, "caller_id string, callee_id string")
    roots = spark.createDataFrame([("s1",), ("s2",), ("n7",), ("absent",)], "root string")
    kept, write = [], traverse.materialise
    monkeypatch.setattr(traverse, "materialise", lambda df, label="stage", by=None: kept.append((label, df.schema)) or write(df, label, by))

    def model():
        starts = {"s1": {"n1", "n6", "n11"}, "s2": {"n2", "n7"}, "n7": {"n7"}}
        for root, ids in starts.items():
            for start in ids:
                for direction in traverse.DIRECTIONS:
                    level, seen = {start}, set()
                    for depth in range(3):
                        for node in level:
                            yield root, start, direction, depth, node
                        seen |= level - {None}
                        step = [(b, a) if direction == "upstream" else (a, b) for a, b in pairs]
                        level = {b for a, b in step if a is not None and a in level} - seen

    for limit in (traverse.MAX_FRONTIER, 0):
        walk = traverse.blast_radius(nodes, edges, roots, 2, max_frontier=limit)
        assert sorted(map(repr, (tuple(r) for r in walk.collect()))) == sorted(map(repr, model()))
    hops = [schema for label, schema in kept if label == "hop"]
    assert hops and all(s[c].dataType.simpleString() == "bigint" for s in hops for c in ("root_id", "node_id"))


def test_reached_files_and_repositories_are_counted_in_one_lookup(spark, monkeypatch):
    from weftgraph.operators import evaluate

    nodes = spark.createDataFrame([("a", "r", "f"), ("b", "r", "f"), ("c", "r:f", "g"), ("d", "r", "f:g"), ("e", None, "r:f"), ("e", None, "r:f"), ("h", "q", None)],
                                  "id string, repo string, file_path string")
    rows = [("x", "x", "upstream", 0, "a"), ("x", "x", "downstream", 0, "a"), ("x", "x", "upstream", 1, "b"), ("x", "x", "downstream", 2, "b"),
            ("x", "x", "upstream", 1, "c"), ("x", "x", "downstream", 1, "d"), ("x", "x", "upstream", 2, "e"), ("y", "y", "upstream", 0, "h"), ("y", "y", "upstream", 1, "lost"),
            (None, "z", "upstream", 1, "a")]
    walk = spark.createDataFrame(rows, "root string, root_id string, direction string, depth int, node_id string")
    summary = traverse.traversal_summary(walk, nodes)
    assert {tuple(r) for r in summary.collect()} == {("x", 3, 2, 2, 2), ("y", 0, 0, 0, 1), (None, 1, 0, 1, 1)}
    assert "Expand" not in summary._jdf.queryExecution().executedPlan().toString()
    lookups, join = [], traverse.lookup_join
    monkeypatch.setattr(traverse, "lookup_join", lambda *a, **k: lookups.append(1) or join(*a, **k))
    if hasattr(evaluate, "lookup_join"):
        monkeypatch.setattr(evaluate, "lookup_join", traverse.lookup_join)
    scores = evaluate.trace_scores(walk, nodes, spark.createDataFrame([("x",), ("y",), ("gone",)], "root string"), 2)
    assert {tuple(r) for r in scores.collect()} == {("x", 3, 2, 3, True), ("y", 1, 1, 0, False), ("gone", 0, 0, 0, False)}
    assert len(lookups) == 1


def test_degrees_are_summed_by_number(spark, monkeypatch):
    from weftgraph.operators import graph

    nodes = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "q"), ("c", "q"), ("d", None), (None, "q"), ("e", "q")], "id string, repo string").select(
        "id", "repo", F.col("id").alias("symbol_name"), F.lit("f").alias("file_path"), F.lit("class").alias("symbol_type"))
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "a"), ("lost", "b"), ("d", "b"), (None, "a"), ("e", None), ("a", "b")], "caller_id string, callee_id string")
    ranking = graph.degree_ranking(nodes, edges)
    got = sorted((str(r.id), r.inbound, r.outbound, r.total_relations, r.is_cross_repo) for r in ranking.collect())
    # the edges of a repeated id count for each of its rows
    assert got == [("None", 0, 0, 0, False), ("a", 3, 4, 7, True), ("b", 4, 0, 4, False), ("c", 2, 2, 4, True), ("c", 2, 2, 4, True), ("d", 0, 1, 1, False), ("e", 0, 1, 1, False)]
    plan = ranking._jdf.queryExecution().analyzed().toString()
    assert re.search(r"Aggregate \[number#", plan) and not re.search(r"Aggregate \[id#", plan)
    monkeypatch.setattr(scale, "MAX_BROADCAST_BYTES", -1)
    long = graph.degree_ranking(nodes, edges)
    assert sorted((str(r.id), r.inbound, r.outbound, r.total_relations, r.is_cross_repo) for r in long.collect()) == got
    assert "ShuffledHashJoin" in long._jdf.queryExecution().executedPlan().toString()


def test_usage_links_read_the_edges_once(spark, tmp_path):
    from weftgraph.operators import graph

    nodes = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "q"), (None, "q")], "id string, repo string").select(
        "id", "repo", F.concat(F.lit("s_"), "id").alias("symbol_name"), F.lit("f").alias("file_path"), F.lit(1).alias("start_line"))
    spark.createDataFrame([("a", "b", "calls"), ("b", "a", "calls"), ("a", "a", "imports"), ("lost", "a", "calls"), (None, "b", "calls"), ("c", "b", "calls")],
                          "caller_id string, callee_id string, edge_type string").write.parquet(f"{tmp_path}/edges")
    links = graph.usage_links(nodes, spark.read.parquet(f"{tmp_path}/edges"), spark.createDataFrame([("a",), ("s_b",)], "target string"))
    got = sorted((r.target, r.direction, r.node_id, r.edge_type, r.repo) for r in links.collect())
    assert got == [("a", "downstream", "a", "imports", "r"), ("a", "downstream", "b", "calls", "r"), ("a", "upstream", "a", "imports", "r"), ("a", "upstream", "b", "calls", "r"),
                   ("s_b", "downstream", "a", "calls", "r"), ("s_b", "upstream", "a", "calls", "r"), ("s_b", "upstream", "c", "calls", "q")]
    assert links._jdf.queryExecution().optimizedPlan().toString().count("caller_id#") and \
        len(re.findall(r"Relation \[caller_id#", links._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_linked_nodes_are_computed_once(spark, tmp_path):
    import __spark_entry__

    tables = {
        "region": ([(0, "EAST")], "r_regionkey int, r_name string"),
        "nation": ([(0, "NORTH", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, 0, "BUILDING")], "c_custkey int, c_nationkey int, c_mktsegment string"),
        "supplier": ([(5, 0, 2000.0)], "s_suppkey int, s_nationkey int, s_acctbal double"),
        "orders": ([(10, 1)], "o_orderkey int, o_custkey int"),
        "lineitem": ([(10, 1, 3, 5, "A", "O"), (10, 2, 3, 5, "R", "O")],
                     "l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int, l_returnflag string, l_linestatus string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    edges = __spark_entry__.queries()["link_repositories"](spark, str(tmp_path))
    assert sorted(r.edge_type for r in edges.collect()) == ["calls", "consumes_api", "consumes_api", "imports"]
    assert "l_orderkey" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_searched_like_the_index(spark, monkeypatch):
    """Row by row, in passes, and over all rows of an id that comes again, the best are those of the index."""
    from weftgraph.operators import row_search, search

    rng = random.Random(11)
    words = ["a", "ab", "abc", "abd", "b", "ba", "bab", "ñu", "ñandu", "x1"]

    def text(most):
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, most))) + rng.choice(["", "!", "-Ab"])

    rows = [(rng.choice([None, f"n{i}", f"n{i}", f"n{i}", "twice"]), rng.choice(words), text(2), rng.choice([None, text(3)]), text(9)) for i in range(60)]
    nodes = spark.createDataFrame(rows, "id string, symbol_name string, signature string, docstring string, code_content string")
    asked = [(i, " ".join(rng.choice(["ab", "AB_ba", "ab-a", "b_a_b", "ñ", "x", "ba", "abd_abc"]) for _ in range(rng.randint(1, 3)))) for i in range(40)]
    queries = spark.createDataFrame([*asked, (40, "ab"), (40, "ba_a"), (41, None), (None, "ñu")], "query_id int, query string")

    def best(nodes, **more):
        return sorted((r.query_id is None, r.query_id or 0, r.rank, r.id or "", r.matched_terms) for r in search.lexical_search(nodes, queries, 4, **more).collect())

    want = best(nodes, index=search.token_index(nodes))
    assert len(want) > 100 and any(x[4] > 1 for x in want)
    assert best(nodes) == want
    monkeypatch.setattr(row_search, "PARTS_PER_PASS", 20)
    monkeypatch.setattr(row_search, "KNOWN_WORDS", 2)
    once = nodes.where("id IS NOT NULL AND id <> 'twice'").repartition(3)
    # only the queries that ask for several texts are looked up in an index
    whole, indexed = search.token_index, []
    monkeypatch.setattr(search, "token_index", lambda n: indexed.append(n) or whole(n))
    found = best(once)
    assert len(indexed) == 1
    assert found == best(once, index=whole(once))


def _random_graph(spark, rng):
    nodes = [(f"r{i % 3}:f{i % 4}:s{i}:1" if i else None, rng.choice(["r0", "r1", "r2", None]), f"f{i % 4}", rng.choice(["a`b", "", "ñ", "z"]), "endpoint", 1, 2, None, "/x", "GET", None, "")
             for i in range(30)] + [("r1:f1:s1:1", "r9", "f", "z", "class", 3, 4, None, None, None, "/y", "")]
    ids = [n[0] for n in nodes] + ["lost", None]
    edges = [(rng.choice(ids[:4]) if rng.random() < 0.4 else rng.choice(ids), rng.choice(ids), rng.choice(["calls", "consumes_api"]), 1.0) for _ in range(300)]
    return (spark.createDataFrame(nodes, "id string, repo string, file_path string, symbol_name string, symbol_type string, start_line int, end_line int, signature string, "
                                         "endpoint_route string, http_method string, consumes_endpoint string, consumes_http_method string"),
            spark.createDataFrame(edges, "caller_id string, callee_id string, edge_type string, confidence double"))


def test_edges_are_joined_slice_by_slice(spark, monkeypatch):
    """Reports, cross-repository edges and walks of a large graph are those of a small one; a slice is joined at a time."""
    from weftgraph.operators import evaluate, report

    nodes, edges = _random_graph(spark, random.Random(8))
    roots = spark.createDataFrame([("z",), ("ñ",), ("r1:f1:s1:1",)], "root string")

    def answers():
        walk = traverse.blast_radius(nodes, edges, roots)
        tables = [report.contract_matrix(nodes, edges), report.blueprint_lines(nodes, edges), evaluate.cross_repo_edges(nodes, edges), walk, evaluate.trace_scores(walk, nodes, roots)]
        return [sorted(map(str, t.collect())) for t in tables]

    small = answers()
    sizes, whole = [], scale._with_ends
    monkeypatch.setattr(scale, "MAX_BROADCAST_ENDS", 3)
    monkeypatch.setattr(scale, "_with_ends", lambda e, *more: sizes.append(e.count()) or whole(e, *more))
    assert answers() == small
    assert len(sizes) == 4 * scale.SLICES and sum(sizes) == 4 * 300 and max(sizes) < 100


def test_a_blueprint_is_written_range_by_range(spark, tmp_path):
    """Part files, taken by name, hold the lines in order, whatever the ranges are; also a caller of many lines is cut."""
    from weftgraph.sources import tables

    rng = random.Random(9)
    rows = [(rng.choice([0, 2, 2, 4, 4, 4, 6]), rng.choice([None, "", "ab", "ab", "a", "ñ"]), rng.choice([None, "", "x", "y", "z"]), rng.choice(["", "k"]), f"line {i}") for i in range(400)]
    lines = spark.createDataFrame(rows, "section int, k1 string, k2 string, k3 string, line string")
    want = [r.line for r in lines.orderBy("section", "k1", "k2", "k3", "line").collect()]
    for name, most in (("one", 1000), ("many", 60)):
        tables.write_blueprint(lines, str(tmp_path / name), lines_per_slice=most)
        parts = sorted(p for p in (tmp_path / name).iterdir() if p.name.startswith("part-"))
        assert [x for p in parts for x in p.read_text().splitlines()] == want
        assert len({p.name[:9] for p in parts}) == (1 if name == "one" else 7)
    tables.write_blueprint(lines.where("false"), str(tmp_path / "none"))
    tables.write_blueprint(lines, str(tmp_path / "packed"), "gzip")
    assert spark.read.text(str(tmp_path / "packed")).count() == 400 and spark.read.text(str(tmp_path / "none")).count() == 0


def test_callers_are_linked_slice_by_slice(spark, monkeypatch):
    """Edges of all kinds are the same in slices, each written by itself; null and repeated callers too."""
    rng = random.Random(10)
    rows = [(rng.choice([None, f"c{i}", f"c{i}", "again"]), f"web_{i % 3}", f"use{i}", "function", rng.choice([["svc_core/lib"], ["from svc_auth import check_all"], []]),
             f"check_all(); AuthClient.load_all(x{i})", None, None, rng.choice(["/v1/x", "/v1/y", None]), "GET", None, i) for i in range(60)]
    rows += [(f"t{i}", f"svc_{('core', 'auth')[i % 2]}", ("check_all", "load_all", "none_all")[i % 3], ("class", "endpoint")[i % 5 == 0], [], "", "/v1/x" if i % 5 == 0 else None, "GET", None, None, None, 100 + i) for i in range(12)]
    nodes = spark.createDataFrame(rows, "id string, repo string, symbol_name string, symbol_type string, file_imports array<string>, code_content string, endpoint_route string, "
                                        "http_method string, consumes_endpoint string, consumes_http_method string, target_base_url string, ordinal int")
    whole = sorted(map(str, link.link_repositories(nodes).collect()))
    assert {r.split("edge_type='")[1].split("'")[0] for r in whole} == {"consumes_api", "imports", "calls"}
    written, write = [], scale.materialise
    monkeypatch.setattr(scale, "SLICE_ROWS", 10)
    monkeypatch.setattr(scale, "materialise", lambda df, label="stage", by=None: written.append(label) or write(df, label, by))
    assert sorted(map(str, link.link_repositories(nodes).collect())) == whole
    assert {written.count(x) for x in ("consumes-api", "imports", "calls")} >= {4}


def _suppliers(spark, folder, n):
    spark.createDataFrame([(i, f"Supplier {i}", i % 3, float(i * 1000 % 9999)) for i in range(n)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(i, f"NATION {i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")


def test_a_tree_of_files_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from weftgraph.plans.catalog import storing

    _suppliers(spark, tmp_path, 40)
    monkeypatch.setattr(storing, "scratch_path", lambda spark, label: str(tmp_path / label))
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    assert sorted(int(r.supplier) for r in storing.read_files(spark, str(tmp_path)).collect()) == list(range(40))
    files = [*(tmp_path / "tree").rglob("part-*.txt")]
    assert len(files) == 40 and len({f.name[:10] for f in files}) > 3
    assert spark.conf.get(name) == before


def test_order_files_are_put_together_once(spark, tmp_path, monkeypatch):
    from weftgraph.plans.catalog import extraction

    _suppliers(spark, tmp_path, 3)
    spark.createDataFrame([(1, 0), (2, 1)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(7, 1), (8, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 1, 5, 1), (7, 2, 6, 2), (8, 1, 5, 0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    given, extract = [], extraction.x.extract_symbols
    monkeypatch.setattr(extraction.x, "extract_symbols", lambda files: given.append(files) or extract(files))
    found = extraction.extract_order_clients(spark, str(tmp_path))
    assert sorted((r.file_path, r.symbol_name, r.start_line, r.end_line, r.consumes_endpoint) for r in found.collect()) == [
        ("src/orders/o7.ts", "line_1", 2, 4, "/v1/suppliers/1/parts/5"), ("src/orders/o7.ts", "line_2", 5, 7, "/v1/suppliers/2/parts/6"),
        ("src/orders/o8.ts", "line_1", 2, 4, "/v1/suppliers/0/parts/5")]
    assert "Window" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
