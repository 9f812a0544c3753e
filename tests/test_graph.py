"""Graph operators on a hand-made ring and against plain versions on random graphs."""

import random
from collections import defaultdict, deque

import pytest

from riskweave.operators import graph, iterate
from riskweave.plans import view

E = "src string, dst string, relation string, qty long, amount double, ts_min timestamp, ts_max timestamp"
V = "id string, type string, name string, root string, flagged int, chargeback_pct double"
STORES = ["LOJA:1", "LOJA:2", "LOJA:3", "LOJA:4", "LOJA:5"]
PEOPLE = ["DOC:1", "DOC:2", "DOC:3", "DOC:4"]
RING = [
    ("LOJA:1", "CONTA:1", "liquida_em", 1, 10.0), ("LOJA:2", "CONTA:1", "liquida_em", 1, 10.0), ("LOJA:4", "CONTA:2", "liquida_em", 1, 10.0), ("LOJA:2", "DOC:2", "socio", 1, None), ("LOJA:3", "DOC:2", "socio", 1, None),
    ("LOJA:1", "DOC:1", "titular", 1, None), ("LOJA:4", "DOC:4", "titular", 1, None),
    ("DOC:1", "DOC:2", "pix", 2, 10000.0), ("DOC:2", "DOC:3", "pix", 1, 12000.0), ("DOC:3", "DOC:1", "pix", 1, 11000.0), ("DOC:1", "DOC:4", "pix", 1, 500.0),
]


@pytest.fixture(scope="module")
def ring(spark):
    import datetime

    t = datetime.datetime(2025, 9, 1)
    e = spark.createDataFrame([(*r, t, t) for r in RING], E)
    v = [(s, "LOJA", s, f"r{s[-1]}", int(s == "LOJA:3"), 0.0) for s in STORES] + [(p, "DOC", p, p, 0, None) for p in PEOPLE] + [(c, "CONTA", c, None, 0, None) for c in ("CONTA:1", "CONTA:2")]
    return graph.PropertyGraph(spark.createDataFrame(v, V), e)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_motifs_of_the_ring(ring):
    assert rows(graph.shared_targets(ring, "liquida_em")) == {("LOJA:1", "LOJA:2", "CONTA:1")}
    assert rows(graph.partner_of_flagged(ring, "socio").select("a")) == {("LOJA:2",)}
    assert rows(graph.cycles3(ring.edges.where("relation = 'pix'"), 10000).select("a", "b", "c")) == {("DOC:1", "DOC:2", "DOC:3")}
    assert graph.cycles3(ring.edges.where("relation = 'pix'"), 10000, canonical=False).count() == 3
    assert graph.cycles4(ring.edges.where("relation = 'pix'"), 0).count() == 0


def test_distances_components_and_orphans_of_the_ring(ring):
    link = ring.edges.where("relation <> 'pix'")
    flagged = ring.vertices.where("flagged = 1")
    got = dict(rows(iterate.nearest_other(ring.vertices, link, flagged)))
    assert {s: got[s] for s in STORES} == {"LOJA:2": 2, "LOJA:1": 4, "LOJA:3": 99, "LOJA:4": 99, "LOJA:5": 99}
    groups = defaultdict(set)
    for i, c in rows(iterate.connected_components(ring.vertices, link)):
        groups[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted([sorted(["LOJA:1", "LOJA:2", "LOJA:3", "DOC:1", "DOC:2", "CONTA:1"]), sorted(["LOJA:4", "DOC:4", "CONTA:2"]), ["DOC:3"], ["LOJA:5"]])
    assert graph.orphan_ends(ring).count() == 0


def test_motif_grammar(ring):
    with pytest.raises(ValueError):
        graph.find(ring.edges, "(a)->(b)")
    with pytest.raises(ValueError):
        graph.find(ring.edges, "(a)-[e]->(b); (c)-[f]->(d)")
    with pytest.raises(ValueError):
        graph.find(ring.edges, "(a)-[e]->(b)", ["zz = 1"])
    assert graph.find(ring.edges, "(a)-[e]->(a)").count() == 0
    plan = graph.find(ring.edges, "(a)-[e1]->(c); (b)-[e2]->(c)", ["a < b"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_resolution_and_pruning(spark, ring):
    g = graph.resolve(ring, spark.createDataFrame([("DOC:1", "IDN:9"), ("DOC:2", "IDN:9"), ("DOC:2", "IDN:9"), (None, "IDN:1")], "id string, to string"))
    e = {(r["src"], r["dst"], r["relation"]): (r["qty"], r["amount"]) for r in g.edges.collect()}
    assert ("IDN:9", "IDN:9", "pix") not in e and e[("DOC:3", "IDN:9", "pix")] == (1, 11000.0)
    assert {r["id"] for r in g.vertices.where("type = 'IDENTIDADE'").collect()} == {"IDN:9"} and graph.orphan_ends(g).count() == 0
    kept = rows(graph.prune(ring, ["liquida_em", "socio"]).edges.select("src", "dst"))
    assert ("LOJA:1", "CONTA:1") in kept and ("LOJA:4", "CONTA:2") not in kept and ("LOJA:2", "DOC:2") in kept


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(8)
    ids = [f"v{i:02}" for i in range(40)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(55)] + [("v00", x) for x in ids[1:12]]
    return ids, pairs, spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string")


def test_components_of_a_random_graph(random_graph):
    ids, pairs, v, e = random_graph
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for i in sorted(ids):
        if i not in want:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = i
                    todo += near[x]
    assert dict(rows(iterate.connected_components(v, e))) == want
    assert dict(rows(iterate.connected_components(v, e.limit(0)))) == {i: i for i in ids}


def test_triangles_ranks_and_labels_of_a_random_graph(random_graph):
    ids, pairs, v, e = random_graph
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {i: sum(y in near[x] for x in near[i] for y in near[i] if x < y) for i in ids}
    got = dict(rows(iterate.triangle_count(v, e)))
    assert got == want and sum(got.values()) % 3 == 0
    ranks = dict(rows(iterate.pagerank(v, e)))
    assert abs(sum(ranks.values()) - len(ids)) < 1e-6
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    r = dict.fromkeys(ids, 1.0)
    for _ in range(10):
        m = defaultdict(float)
        for a, bs in out.items():
            for b in bs:
                m[b] += r[a] / len(bs)
        r = {i: 0.15 + 0.85 * m[i] for i in ids}
    total = sum(r.values())
    assert all(abs(ranks[i] - r[i] * len(ids) / total) < 1e-9 for i in ids)
    lab = {i: i for i in ids}
    both = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    for _ in range(5):
        votes = defaultdict(lambda: defaultdict(int))
        for a, b in both:
            votes[b][lab[a]] += 1
        lab = {i: min(votes[i].items(), key=lambda x: (-x[1], x[0]))[0] if i in votes else lab[i] for i in ids}
    assert dict(rows(iterate.label_propagation(v, e))) == lab


def test_nearest_other_landmark_of_a_random_graph(spark, random_graph):
    ids, pairs, v, e = random_graph
    marks = ["v03", "v17", "v30"]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    dist = {}
    for m in marks:
        d, todo = {m: 0}, deque([m])
        while todo:
            x = todo.popleft()
            for y in near[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    todo.append(y)
        dist[m] = d
    want = {i: min((dist[m][i] for m in marks if m != i and i in dist[m]), default=99) for i in ids}
    assert dict(rows(iterate.nearest_other(v, e, spark.createDataFrame([(m,) for m in marks], "id string")))) == want


def test_network_view_of_the_ring(spark, ring):
    v = {r["id"]: r for r in ring.vertices.collect()}
    r = [(s, d, rel, q, a, v[s]["type"], s, v[s]["flagged"], v[d]["type"], d, v[d]["flagged"]) for s, d, rel, q, a in RING]
    df = spark.createDataFrame(r, "src string, dst string, relation string, qty long, amount double, src_type string, src_name string, src_flagged int, dst_type string, dst_name string, dst_flagged int")
    levels = {x["target"]: x["level"] for x in view.attribute_levels(df).collect()}
    assert levels == {"CONTA:1": "alerta", "CONTA:2": "normal", "DOC:2": "fraude", "DOC:1": "normal", "DOC:4": "normal"}
    flows = {(x["a"], x["b"]): (x["ab"], x["ba"], x["in_cycle"], x["source"]) for x in view.pair_flows(df, "LOJA:1").collect()}
    # DOC:2 belongs to stores 2 and 3: the least stands for it; DOC:3 has no store
    assert flows == {("LOJA:1", "LOJA:2"): (10000.0, 0.0, True, "LOJA:1"), ("LOJA:2", view.NO_STORE): (12000.0, 0.0, True, "LOJA:2"), ("LOJA:1", view.NO_STORE): (0.0, 11000.0, True, view.NO_STORE), ("LOJA:1", "LOJA:4"): (500.0, 0.0, False, "LOJA:1")}
    assert rows(view.flow_cycles(df)) == {("DOC:1", "DOC:2", "DOC:3")}
    s = [(x["about"], x["level"]) for x in view.signals(df, "LOJA:1").collect()]
    assert s[0] == ("attribute", "fraude") and ("cycles", "alerta") in s and ("total_flow", "alerta") in s
    places = dict(rows(view.store_order(df, "LOJA:1")))
    assert places["LOJA:1"] == 0 and places["LOJA:3"] == 1
    totals = {x["entity"]: (x["sent"], x["received"]) for x in view.flow_totals(df, "LOJA:1").collect()}
    assert totals["LOJA:1"] == (10500.0, 11000.0)


def test_vertices_are_completed_with_the_most_mentioned_name(spark, ring):
    from riskweave.plans.silver import graph_vertices

    stores = spark.createDataFrame([(1, "ONE", "r1", 0, 0.5)], "nu_ec long, name string, root string, flagged int, chargeback_pct double")
    said = spark.createDataFrame([("1", "ANA", 2), ("1", "ANNA", 1), ("2", None, 9)], "document string, name string, occurrences long")
    got = {r["id"]: r for r in graph_vertices(stores, ring.edges, said).collect()}
    assert got["LOJA:1"]["name"] == "ONE" and got["DOC:1"]["name"] == "ANA" and got["DOC:2"]["name"] == "2" and got["CONTA:1"]["type"] == "CONTA"
    assert set(got) == {x for r in RING for x in r[:2]}
