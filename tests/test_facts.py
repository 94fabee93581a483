"""Small facts about routes, extraction, linking and streams."""

import numpy as np
from pyspark.sql import functions as F

from weftgraph.functions import routes as r
from weftgraph.operators import link, memory, search
from weftgraph.operators.extract import extract_symbols, notebook_code
from weftgraph.plans.index import index_files, with_ordinal
from weftgraph.schema import EDGES, NODES
from weftgraph.sources.files import explode_lines, read_files
from weftgraph.sources.snapshots import SnapshotStore
from weftgraph.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalize(spark):
    for raw, want in [
        ("https://api.corp.internal/api/v1/users/info", "/v1/users/info"), ("/api/v2/auth/token?env=prod", "/v2/auth/token"),
        ("", "/"), ("///", "/"), ("users", "/users"), ("api/x", "/x"), ("/api", "/api"), ("/api/", "/"), ("//x//", "//x"),
        ("https://h", "/"), (" /a/ ", "/a"), ("http://", "/http:"), ("/api//x", "//x"), ("/apix/y", "/apix/y"),
    ]:
        assert one(spark, r.normalize_route(F.lit(raw))) == want, raw


def test_canonical_and_matches(spark):
    for raw in ("/users/{id}", "/users/:userId", "/users/<int:id>", "/users/${userId}"):
        assert one(spark, r.canonical_route(F.lit(raw))) == "/users/{_param_}"
    for a, b, want in [
        ("/users/{id}", "/users/123", True), ("/api/v1/orders/{orderId}/items", "/v1/orders/999/items", True),
        ("/posts/:postId/comments", "/posts/42/comments", True), ("/users/{id}", "/orders/123", False), ("/users/{id}", "/users/123/profile", False), ("", "/x", False),
    ]:
        assert one(spark, r.route_matches(F.lit(a), F.lit(b))) is want, (a, b)


def test_repo_name(spark):
    for raw, want in [("https://github.com/pallets/flask.git", "flask"), ("https://github.com/fastapi/fastapi/", "fastapi"), ("local/path/to/my_service", "my_service")]:
        assert one(spark, r.repo_name(F.lit(raw))) == want


def files(spark, *rows):
    return spark.createDataFrame([("repo_a", p, c) for p, c in rows], "repo string, file_path string, content string")


def test_extraction_facts(spark):
    df = files(
        spark,
        ("a.py", '@router.get("/v1/users/{user_id}")\ndef get_user(user_id):\n    return 1\n\n@bp.route("/api/v2/auth/login", methods=["POST", "GET"])\ndef login():\n    pass\n'),
        ("b.py", 'def fetch_user(uid):\n    return requests.get(f"https://api.internal/v1/users/{uid}")\n'),
        ("c.ts", "export async function order(id) {\n  return axios.post(`https://x.io/v1/orders/${id}`);\n}\nconst logs = async () => {\n  return ky.get('/v1/audit/logs');\n}\n"),
        ("d.ts", "export function join(a, b) {\n  return a + '/' + b;\n}\n"),
        ("deploy.sh", "function deploy_service() {\n  echo hi\n}\n"),
        ("app/api/users/route.ts", "export async function POST(req) {\n  return 1;\n}\n"),
        ("long.go", "package x\nfunc Big() {\n" + "  a()\n" * 45 + "}\n"),
    )
    got = {(s.file_path, s.symbol_name): s for s in extract_symbols(df).collect()}
    assert (got["a.py", "get_user"].endpoint_route, got["a.py", "get_user"].http_method) == ("/v1/users/{user_id}", "GET")
    assert (got["a.py", "login"].endpoint_route, got["a.py", "login"].http_method) == ("/api/v2/auth/login", "POST")
    assert (got["b.py", "fetch_user"].consumes_endpoint, got["b.py", "fetch_user"].target_base_url) == ("/v1/users/{uid}", "api.internal")
    assert (got["c.ts", "order"].consumes_endpoint, got["c.ts", "order"].consumes_http_method) == ("/v1/orders/", "POST")
    assert got["c.ts", "logs"].consumes_endpoint == "/v1/audit/logs"
    assert got["d.ts", "join"].consumes_endpoint is None
    assert got["deploy.sh", "deploy_service"].end_line == 3
    assert (got["app/api/users/route.ts", "POST"].endpoint_route, got["app/api/users/route.ts", "POST"].http_method) == ("/api/users", "POST")
    assert got["long.go", "Big"].end_line == 48 and len(got) == 9


def test_lines_cut_like_splitlines(spark):
    text = "a\r\nb\rc\x0bd\x85e \n\nz"
    got = [x.line for x in explode_lines(files(spark, ("x", text))).orderBy("line_no").collect()]
    assert got == text.splitlines()


def test_read_files(spark, tmp_path):
    for path, data in {"one/src/a.py": b"x = 1\n", "one/node_modules/b.py": b"", "two/c.go": b"bad \xff byte", "two/readme.md": b""}.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    got = {(x.repo, x.file_path): x.content for x in read_files(spark, str(tmp_path)).collect()}
    assert got == {("one", "src/a.py"): "x = 1\n", ("two", "c.go"): "bad � byte"}


def test_index_links_two_repositories(spark):
    df = spark.createDataFrame([
        ("svc_users", "a.py", '@app.get("/v1/users/{user_id}")\ndef get_user(user_id):\n    return 1\n'),
        ("web", "b.ts", "export function load(id) {\n  return fetch('/v1/users/user_9921');\n}\n"),
    ], "repo string, file_path string, content string")
    nodes, internal, cross = index_files(df)
    edge = cross.collect()
    assert nodes.count() == 2 and internal.count() == 0
    assert [(e.edge_type, e.caller_repo, e.target_repo) for e in edge] == [("consumes_api", "web", "svc_users")]


def test_stream_links_and_forgets(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "repo string, file_path string, content string, version int"
    first = [("svc_users", "a.py", '@app.get("/v1/users/{user_id}")\ndef get_user(user_id):\n    return 1\n', 1),
             ("web", "b.ts", "export function load(id) {\n  return fetch('/v1/users/user_9921');\n}\n", 1),
             ("web", "b.ts", "export function early(id) {\n  return 1;\n}\n", 0), ("old", "c.py", "def c():\n    pass\n", 1), ("old one", "d.py", "def d():\n    pass\n", 1)]
    second = [("old", "c.py", "# nothing", 2), ("old one", "d.py", None, 2)]
    seen = []
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        jobs.ingest(spark.readStream.schema(schema).parquet(inbox), store, version="version").awaitTermination()
        now = SnapshotStore(spark, store)
        seen.append(sorted(n.symbol_name for n in now.read("nodes", NODES).collect()))
        edges = now.read("edges", EDGES).collect()
        assert [(e.edge_type, e.caller_repo, e.target_repo) for e in edges] == [("consumes_api", "web", "svc_users")]
    assert seen == [["c", "d", "get_user", "load"], ["get_user", "load"]]


def test_notebook_cells_keep_their_text(spark):
    text = '{"cells": [{"cell_type": "code", "source": ["a = 1\\n", "b"]}, {"cell_type": "code", "source": "[\\"a\\", \\"b\\"]"}, {"cell_type": "markdown", "source": "x"}]}'
    assert one(spark, notebook_code(F.lit(text))) == 'a = 1\nb\n["a", "b"]\n'


def test_vector_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, f"r{i % 3}", rng.integers(-3, 4, 4).astype(float).tolist() if i % 11 else None) for i in range(90)]
    vectors = spark.createDataFrame(rows, "id long, repo string, embedding array<double>")
    queries = [(i, "r1" if i % 2 else None, rows[i][2]) for i in range(40)]
    monkeypatch.setattr(search, "QUERIES_PER_BLOCK", 7)
    got = {}
    for r in search.cosine_topk_batch(vectors, spark.createDataFrame(queries, "query_id long, repo string, embedding array<double>"), 3).collect():
        got.setdefault(r.query_id, []).append((round(r.score, 9), r.rank))

    def cos(a, b):
        return 0.0 if not a or not b or not any(a) or not any(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    for i, repo, v in queries:
        want = sorted((round(cos(v, w), 9) for _, r, w in rows if repo in (None, r)), reverse=True)[:3]
        assert sorted(got[i], key=lambda x: x[1]) == [(s, k + 1) for k, s in enumerate(want)]


def test_text_session_ids(spark):
    df = spark.createDataFrame([("s-1", t, "user", "w" * 40) for t in range(6)], "session string, turn long, role string, text string")
    kept = memory.compact(df, 3, 10_000)
    assert {r.session for r in kept.collect()} == {"s-1"} and kept.where("kind = 'window'").count() == 3


def test_root_needs_a_named_host(spark):
    nodes = spark.createDataFrame([
        ("p", "repo_pay_core", "home", "endpoint", "/", "GET", None, None, None), ("c1", "web", "u1", "function", None, None, "/", "GET", None),
        ("c2", "web", "u2", "function", None, None, "/", "GET", "pay-core.internal"), ("c3", "web", "u3", "function", None, None, "/", "GET", "other.io"),
    ], "id string, repo string, symbol_name string, symbol_type string, endpoint_route string, http_method string, consumes_endpoint string, consumes_http_method string, target_base_url string")
    nodes = nodes.withColumns({"file_path": F.lit("x"), "start_line": F.lit(1)})
    assert [e.caller_id for e in link.consumes_api_edges(with_ordinal(nodes)).collect()] == ["c2"]


def test_memory_facts(spark):
    rows = [(1, t, "user", f"m{t}") for t in range(5)]
    df = spark.createDataFrame(rows, "session long, turn long, role string, text string")
    context = memory.context_messages(memory.compact(df, 4, 10_000)).orderBy("part", "ord").collect()
    assert len(context) == 5 and context[0].text.startswith("[Prior conversation summary]") and context[-1].text == "m4"
