"""Changes applied one after the other give the graph of the files as they are; a change is seen whole or not at all."""

import random

import pytest

from weftgraph.operators import relink
from weftgraph.operators.extract import defines_edges, extract_symbols, intra_file_calls
from weftgraph.operators.link import link_repositories
from weftgraph.plans.index import with_ordinal
from weftgraph.schema import EDGES, NODES, conform
from weftgraph.sources.snapshots import SnapshotStore
from weftgraph.streaming import jobs

FILES = "repo string, file_path string, content string"


def service(name, route, method="get"):
    return f'@app.{method}("{route}")\ndef {name}(user_id):\n    return tidy(user_id)\n\ndef tidy(x):\n    return x\n'


def web(name, route):
    return f"export function {name}(id) {{\n  return fetch('{route}');\n}}\n"


def client(repo, name):
    return f"from {repo} import {name}\n\ndef use_it(x):\n    return {name}(x)\n\nclass Kept:\n    pass\n"


#: What each file may hold in turn; None: it is deleted.
VARIANTS = {
    ("svc_users", "a.py"): [service("get_user", "/v1/users/{user_id}"), service("get_user", "/v1/people/{user_id}"), service("fetch_member", "/v1/users/9921"), None],
    ("svc_orders", "b.py"): [service("place_order", "/v1/orders", "post"), service("get_user", "/v1/users/{user_id}"), "# nothing\n", service("place_order", "/v1/users/{a}")],
    ("web", "c.ts"): [web("load", "/v1/users/9921"), web("load", "/v1/orders"), web("early", "/v1/people/7"), None],
    ("web", "d.ts"): [web("other", "/v1/users/5"), "const x = 1;\n"],
    ("tools", "e.py"): [client("svc_users", "get_user"), client("svc_orders", "place_order"), client("svc_users", "tidy")],
    ("batch", "f.py"): [client("svc_orders", "get_user"), client("svc_users", "fetch_member"), None],
}


def full_graph(spark, files):
    rows = [(*k, v) for k, v in files.items() if v is not None]
    found = extract_symbols(spark.createDataFrame(rows, FILES))
    nodes = conform(found, NODES)
    edges = defines_edges(found).unionByName(intra_file_calls(found)).unionByName(link_repositories(with_ordinal(nodes)))
    return sorted(map(str, nodes.collect())), sorted(map(str, conform(edges, EDGES).collect()))


def stored_graph(store):
    return sorted(map(str, store.read("nodes", NODES).collect())), sorted(map(str, store.read("edges", EDGES).collect()))


def test_changes_give_the_graph_of_a_full_run(spark, tmp_path):
    draw, store, files, kinds = random.Random(2), SnapshotStore(spark, str(tmp_path), buckets=3), {}, set()
    for number in range(3):
        chosen = list(VARIANTS) if number == 0 else draw.sample(list(VARIANTS), 2)
        change = {k: VARIANTS[k][0] if number == 0 else draw.choice(VARIANTS[k]) for k in chosen}
        files |= change
        assert jobs.apply_changes(store, spark.createDataFrame([(*k, v) for k, v in change.items()], FILES), number)
        got, want = stored_graph(store), full_graph(spark, files)
        assert got == want, number
        kinds |= {r.edge_type for r in store.read("edges", EDGES).where("target_repo IS NOT NULL").collect()}
        store.vacuum()
    assert kinds == {"consumes_api", "imports", "calls"}


def test_a_change_reaches_only_its_callers(spark):
    def nodes(files):
        return with_ordinal(conform(extract_symbols(spark.createDataFrame([(*k, v) for k, v in files.items()], FILES)), NODES))

    first = {k: v[0] for k, v in VARIANTS.items()}
    changed = {("svc_users", "a.py"): service("get_user", "/v1/people/{user_id}") }
    after = nodes(first | changed)
    reached = {r.id.split(":")[0] + ":" + r.id.split(":")[2] for r in relink.reached_callers(
        after, nodes({k: first[k] for k in changed}), nodes(changed)).collect()}
    # consumers of the old and the new route; the importer's symbol is where it was
    assert reached == {"svc_users:get_user", "svc_users:tidy", "web:load", "web:other"}


def test_a_failed_change_is_not_seen(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path), buckets=2)
    first = spark.createDataFrame([(*k, VARIANTS[k][0]) for k in VARIANTS], FILES)
    second = spark.createDataFrame([("svc_users", "a.py", None), ("web", "c.ts", VARIANTS["web", "c.ts"][1])], FILES)
    assert jobs.apply_changes(store, first, 0)
    before = stored_graph(store)
    stage = SnapshotStore.stage

    def fail(self, snapshot, table, *rest):
        stage(self, snapshot, table, *rest)
        if table == "edges":
            raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "stage", fail)
        with pytest.raises(OSError):
            jobs.apply_changes(store, second, 1)
    assert stored_graph(store) == before and store.current().batch == 0
    assert jobs.apply_changes(store, second, 1)
    done = stored_graph(store)
    assert done != before
    assert not jobs.apply_changes(store, first, 1) and not jobs.apply_changes(store, first, 0) and stored_graph(store) == done
    store.vacuum(keep=1)
    assert stored_graph(store) == done and store.commits() == [2]
