"""Queries of the graph operators over the edge table, with their SQL.

Vertices come from the ends of the edges: a store's root is that of its owner's
document, its chargeback that of its last month. Stores whose number ends in 3
count as flagged: the data hold no watch list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import features, graph, iterate
from riskweave.operators.relational import latest_snapshot
from riskweave.registry import Registry
from riskweave.runtime import Cuts, read

HUB = "tbciar_re_hub_dado_risc_cred"
R = Registry()
QUERIES, SQL = R.queries, R.sql

DIRECT = ["socio", "liquida_em", "localizada_em"]
VIA_OWNER = ["recebe_em", "paga_com", "tem_telefone", "tem_email", "usa_dispositivo"]
LINKS = ["titular", *DIRECT, *VIA_OWNER, "entrega_em"]
#: Least amounts of the cycle queries in these small data.
CYCLE3, CYCLE4 = 100.0, 150.0
FLAG_DIGIT = 3


def edges(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "grafo_arestas").select("src", "dst", F.col("relacao").alias("relation"), F.col("qt").alias("qty"), F.col("valor").alias("amount"), "ts_min", "ts_max")


def vertices(spark: SparkSession, d: str, e: DataFrame | None = None) -> DataFrame:
    e = edges(spark, d) if e is None else e
    ids = graph.endpoints(e)
    owner = e.where("relation = 'titular'").groupBy(F.col("src").alias("id")).agg(F.min(F.substring("dst", 5, 1 << 20)).alias("doc"))
    last = latest_snapshot(read(spark, d, HUB), "NU_EC", "CD_MES", "DT_CRGA", ["PC_CHRG"]).select(F.concat(F.lit("LOJA:"), F.col("NU_EC").cast("string")).alias("id"), F.col("PC_CHRG").alias("chargeback"))
    v = ids.join(owner, "id", "left").join(last, "id", "left")
    kind, value = F.substring_index("id", ":", 1), F.expr("substring(id, instr(id, ':') + 1)")
    store = kind == "LOJA"
    root = lambda c: F.when(F.length(c) == 14, F.substring(c, 1, 8)).otherwise(c)
    return v.select(
        "id", graph.id_type(F.col("id")).alias("type"), value.alias("name"), F.when(store, F.coalesce(root(F.col("doc")), F.col("id"))).when(kind == "DOC", root(value)).alias("root"),
        F.when(store & (F.substring("id", -1, 1) == str(FLAG_DIGIT)), 1).otherwise(0).alias("flagged"), F.when(store, F.coalesce("chargeback", F.lit(0.0))).alias("chargeback_pct"),
    )


def whole(spark: SparkSession, d: str) -> graph.PropertyGraph:
    e = edges(spark, d)
    return graph.PropertyGraph(vertices(spark, d, e), e)


_TYPES = "CASE split_part(id, ':', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.VERTEX_TYPES.items()) + " END"
_ROOT = "CASE WHEN length({0}) = 14 THEN substr({0}, 1, 8) ELSE {0} END"
G = f"""E AS MATERIALIZED (SELECT src, dst, relacao AS relation, qt AS qty, valor AS amount, ts_min, ts_max FROM grafo_arestas),
 ids AS (SELECT src AS id FROM E UNION SELECT dst FROM E),
 own AS (SELECT src AS id, min(substr(dst, 5)) AS doc FROM E WHERE relation = 'titular' GROUP BY 1),
 cb AS (SELECT 'LOJA:' || NU_EC AS id, PC_CHRG AS chargeback FROM (SELECT NU_EC, PC_CHRG, row_number() OVER (PARTITION BY NU_EC ORDER BY CD_MES DESC, DT_CRGA DESC NULLS LAST, PC_CHRG DESC NULLS LAST) AS rn FROM {HUB}) WHERE rn = 1),
 V AS MATERIALIZED (SELECT id, {_TYPES} AS type, substr(id, strpos(id, ':') + 1) AS name,
  CASE WHEN id LIKE 'LOJA:%' THEN coalesce({_ROOT.format('doc')}, id) WHEN id LIKE 'DOC:%' THEN {_ROOT.format('substr(id, 5)')} END AS root,
  CASE WHEN id LIKE 'LOJA:%{FLAG_DIGIT}' THEN 1 ELSE 0 END AS flagged, CASE WHEN id LIKE 'LOJA:%' THEN coalesce(chargeback, 0) END AS chargeback_pct
  FROM ids LEFT JOIN own USING (id) LEFT JOIN cb USING (id))"""


# ---- building and counting --------------------------------------------------


@R.add("SELECT 'C:' || o_custkey AS src, 'S:' || l_suppkey AS dst, count(*) AS qty, round(sum(l_extendedprice), 2) AS amount, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def edge_build(spark: SparkSession, d: str) -> DataFrame:
    """Purchase edges customer to supplier."""
    j = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_extendedprice"), "o_orderkey")
    at = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = graph.build_edges(j, at("C:", "o_custkey"), at("S:", "l_suppkey"), "buys", F.col("l_extendedprice"), F.col("o_orderdate"))
    return e.select("src", "dst", "qty", F.round("amount", 2).alias("amount"), F.date_format("ts_min", "yyyy-MM-dd").alias("first"), F.date_format("ts_max", "yyyy-MM-dd").alias("last"))


@R.add(f"WITH {G} SELECT id, type, name, root, flagged, chargeback_pct FROM V")
def vertex_build(spark: SparkSession, d: str) -> DataFrame:
    """Stores first, then all other ends of edges by anti-join."""
    e = edges(spark, d)
    v = vertices(spark, d, e).where("type = 'LOJA'")
    return graph.complete_vertices(v, e)


@R.add(f"WITH {G} SELECT relation, count(*) AS rows, sum(qty) AS qty, round(sum(amount), 2) AS amount FROM E GROUP BY 1")
def edge_stats(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("rows"), F.sum("qty").alias("qty"), F.round(F.sum("amount"), 2).alias("amount"))


@R.add(f"WITH {G} SELECT type, count(*) AS rows FROM V GROUP BY 1")
def vertex_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.count_by(vertices(spark, d), {"type": F.col("type")})


@R.add(f"WITH {G}, top AS (SELECT src FROM E WHERE src LIKE 'LOJA:%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT e.src, e.dst, e.relation, e.qty FROM E e, top WHERE (e.src = top.src OR e.dst = top.src) AND relation <> 'compra'")
def neighborhood_1hop(spark: SparkSession, d: str) -> DataFrame:
    """Edges at the store with most links, purchases left out."""
    e = edges(spark, d)
    top = e.where("src like 'LOJA:%'").groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").select("src").first()
    return graph.neighborhood(e, top[0] if top else "", ["compra"]).select("src", "dst", "relation", "qty")


@R.add(f"WITH {G}, x AS (SELECT src AS id, 0 AS i, 1 AS o FROM E UNION ALL SELECT dst, 1, 0 FROM E) SELECT id, count(*) AS degree, sum(i) AS in_degree, sum(o) AS out_degree FROM x GROUP BY 1")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edges(spark, d))


@R.add(f"WITH {G}, x AS (SELECT src AS id FROM E UNION ALL SELECT dst FROM E), g AS (SELECT id, count(*) AS n FROM x GROUP BY 1) SELECT type, count(*) AS rows, round(avg(n), 2) AS mean, max(n) AS most FROM g JOIN V USING (id) GROUP BY 1")
def degree_by_type(spark: SparkSession, d: str) -> DataFrame:
    g = whole(spark, d)
    return graph.degrees(g.edges).join(g.vertices.select("id", "type"), "id").groupBy("type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("degree"), 2).alias("mean"), F.max("degree").alias("most"))


@R.add(f"WITH {G} SELECT CAST(0 AS BIGINT) AS orphans, (SELECT count(*) FROM V) AS vertices")
def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    g = whole(spark, d)
    return graph.orphan_ends(g).agg(F.count(F.lit(1)).alias("orphans")).join(F.broadcast(g.vertices.agg(F.count(F.lit(1)).alias("vertices"))))


# ---- motifs and projections -------------------------------------------------


@R.add(f"WITH {G} SELECT x.src AS a, y.src AS b, x.dst AS c FROM E x JOIN E y ON x.dst = y.dst AND x.src < y.src JOIN V va ON va.id = x.src AND va.type = 'LOJA' JOIN V vb ON vb.id = y.src AND vb.type = 'LOJA' WHERE x.relation = 'liquida_em' AND y.relation = 'liquida_em' AND va.root <> vb.root")
def motif_shared_attribute(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_targets(whole(spark, d), "liquida_em")


@R.add(f"WITH {G} SELECT x.src AS a, y.src AS b, x.dst AS c FROM E x JOIN E y ON x.dst = y.dst AND x.src <> y.src JOIN V va ON va.id = x.src AND va.type = 'LOJA' JOIN V vb ON vb.id = y.src AND vb.type = 'LOJA' WHERE x.relation = 'socio' AND y.relation = 'socio' AND va.flagged = 0 AND vb.flagged = 1")
def motif_shared_partner_flagged(spark: SparkSession, d: str) -> DataFrame:
    return graph.partner_of_flagged(whole(spark, d), "socio")


_FLOWS = """ev AS (SELECT user_id AS a, lead(user_id) OVER (ORDER BY ts, event_id) AS b, value, ts FROM events),
 p0 AS MATERIALIZED (SELECT 'U:' || a AS src, 'U:' || b AS dst, sum(value) AS amount, min(ts) AS ts_min, max(ts) AS ts_max FROM ev WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2)"""
_LEG = "SELECT src, dst, amount, ts_min, ts_max FROM E WHERE relation = 'pix' AND amount >= {0} AND src <> dst"


def event_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flow edges between the users of consecutive events, amounts summed.

    The follower of an event is found by consecutive ranks, so no task sorts
    all events.
    """
    from riskweave.operators.relational import rank_rows

    e = Cuts(spark, "flows").put(rank_rows(read(spark, d, "events").select("event_id", "user_id", "value", "ts"), [F.col("ts"), F.col("event_id")], "k"))
    nxt = e.select((F.col("k") - 1).alias("k"), F.col("user_id").alias("b"))
    at = lambda c: F.concat(F.lit("U:"), F.col(c).cast("string"))
    return graph.build_edges(e.join(nxt, "k"), at("user_id"), at("b"), "flow", F.col("value"), F.col("ts"))


@R.add(f"WITH {_FLOWS}, p AS (SELECT * FROM p0 WHERE amount >= {CYCLE3}) SELECT x.src AS a, y.src AS b, z.src AS c, round(x.amount, 2) AS ab, round(y.amount, 2) AS bc, round(z.amount, 2) AS ca FROM p x JOIN p y ON x.dst = y.src JOIN p z ON y.dst = z.src AND z.dst = x.src WHERE x.src < y.src AND x.src < z.src AND x.ts_min <= y.ts_max AND y.ts_min <= z.ts_max")
def motif_cycle3(spark: SparkSession, d: str) -> DataFrame:
    m = graph.cycles3(event_flows(spark, d), CYCLE3)
    return m.select("a", "b", "c", F.round("e1_amount", 2).alias("ab"), F.round("e2_amount", 2).alias("bc"), F.round("e3_amount", 2).alias("ca"))


@R.add(f"WITH {_FLOWS}, p AS (SELECT * FROM p0 WHERE amount >= {CYCLE4}) SELECT w.src AS a, x.src AS b, y.src AS c, z.src AS d FROM p w JOIN p x ON w.dst = x.src JOIN p y ON x.dst = y.src JOIN p z ON y.dst = z.src AND z.dst = w.src WHERE w.src < x.src AND w.src < y.src AND w.src < z.src AND x.src <> z.src")
def motif_cycle4(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles4(event_flows(spark, d), CYCLE4)


_ATTR = f"""la0 AS (SELECT src AS store, dst AS attribute, relation AS via FROM E WHERE relation IN ({', '.join(f"'{r}'" for r in DIRECT)})
  UNION SELECT t.src, r.dst, 'titular>' || r.relation FROM E t JOIN E r ON r.src = t.dst WHERE t.relation = 'titular' AND r.relation IN ({', '.join(f"'{r}'" for r in VIA_OWNER)})),
 la1 AS (SELECT DISTINCT store, root, attribute, via FROM la0 JOIN V ON V.id = store AND V.type = 'LOJA'),
 la AS MATERIALIZED (SELECT * FROM la1 WHERE attribute IN (SELECT attribute FROM la1 GROUP BY 1 HAVING count(DISTINCT store) <= 50))"""


def _attributes(g: graph.PropertyGraph) -> DataFrame:
    return graph.store_attributes(g, DIRECT, VIA_OWNER)


@R.add(f"WITH {G}, {_ATTR} SELECT store, root, attribute, via FROM la")
def motif_attribute_2hop(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(whole(spark, d))


_PAIRS = f"{_ATTR}, pairs AS MATERIALIZED (SELECT a.store AS store_a, b.store AS store_b, count(DISTINCT a.attribute) AS attributes, list_sort(list(DISTINCT a.via)) AS via FROM la a JOIN la b ON a.attribute = b.attribute AND a.store < b.store AND a.root <> b.root GROUP BY 1, 2)"


def _pairs(g: graph.PropertyGraph) -> DataFrame:
    return graph.store_pairs(_attributes(g))


@R.add(f"WITH {G}, {_PAIRS} SELECT store_a, store_b, attributes, array_to_string(via, ',') AS via FROM pairs")
def merchant_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(whole(spark, d)).withColumn("via", F.array_join("via", ","))


@R.add(f"WITH {G}, {_PAIRS}, both_ AS (SELECT store_a AS store, store_b AS other, via FROM pairs UNION ALL SELECT store_b, store_a, via FROM pairs) SELECT store, count(DISTINCT other) AS linked_stores, array_to_string(list_sort(list_distinct(flatten(list(via)))), ',') AS via FROM both_ GROUP BY 1")
def new_merchant_rank(spark: SparkSession, d: str) -> DataFrame:
    return graph.linked_store_rank(_pairs(whole(spark, d))).withColumn("via", F.array_join("via", ","))


_SIDES = "n AS (SELECT DISTINCT name, key FROM (SELECT tx_pix_nm_pgdr AS name, regexp_replace(nu_pix_cpf_cnpj_pgdr, '[^0-9]', '', 'g') AS key FROM tbciar_tr_lynx_trns_pix UNION ALL SELECT nm_recr, regexp_replace(nu_cpf_cnpj_recr, '[^0-9]', '', 'g') FROM tbciar_tr_lynx_trns_pix) WHERE name IS NOT NULL AND key IS NOT NULL)"


@R.add(f"WITH {_SIDES} SELECT a.name, a.key AS key_a, b.key AS key_b FROM n a JOIN n b ON a.name = b.name AND a.key < b.key WHERE levenshtein(a.key, b.key) = 1")
def same_name_edit1(spark: SparkSession, d: str) -> DataFrame:
    """Documents one digit apart under one name among payers and receivers."""
    p = read(spark, d, "tbciar_tr_lynx_trns_pix")
    side = lambda n, k: p.select(F.col(n).alias("name"), F.regexp_replace(k, "[^0-9]", "").alias("key"))
    return graph.same_name_one_edit(side("tx_pix_nm_pgdr", "nu_pix_cpf_cnpj_pgdr").unionByName(side("nm_recr", "nu_cpf_cnpj_recr")).distinct(), "key", "name")


_MAP = "map AS (SELECT 'DOC:' || cpf_cnpj AS id, min(id_identidade) AS target FROM identidade WHERE cpf_cnpj IS NOT NULL AND id_identidade IS NOT NULL GROUP BY 1)"
_RESOLVED = f"""{_MAP}, RE AS MATERIALIZED (SELECT src, dst, relation, sum(qty) AS qty, sum(amount) AS amount, min(ts_min) AS ts_min, max(ts_max) AS ts_max FROM (SELECT coalesce(a.target, E.src) AS src, coalesce(b.target, E.dst) AS dst, relation, qty, amount, ts_min, ts_max FROM E LEFT JOIN map a ON a.id = E.src LEFT JOIN map b ON b.id = E.dst) WHERE src <> dst GROUP BY 1, 2, 3),
 RV AS MATERIALIZED (SELECT V.id, type, name, root, flagged, chargeback_pct FROM V LEFT JOIN map ON map.id = V.id WHERE map.target IS NULL UNION ALL SELECT map.target, 'IDENTIDADE', min(name), min(root), min(flagged), min(chargeback_pct) FROM V JOIN map ON map.id = V.id GROUP BY 1)"""


def resolved(spark: SparkSession, d: str) -> graph.PropertyGraph:
    m = read(spark, d, "identidade").select(F.concat(F.lit("DOC:"), "cpf_cnpj").alias("id"), F.col("id_identidade").alias("to"))
    g = graph.resolve(whole(spark, d), m)
    cuts = Cuts(spark, "resolved")
    return graph.PropertyGraph(cuts.put(g.vertices), cuts.put(g.edges))


@R.add(f"WITH {G}, {_RESOLVED} SELECT src, dst, relation, qty, round(amount, 2) AS amount FROM RE")
def graph_resolve(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).edges.select("src", "dst", "relation", "qty", F.round("amount", 2).alias("amount"))


@R.add(f"WITH {G}, {_RESOLVED} SELECT 'vertices' AS metric, (SELECT count(*) FROM V) AS before, (SELECT count(*) FROM RV) AS after UNION ALL SELECT 'people', (SELECT count(*) FROM V WHERE type IN ('DOC', 'IDENTIDADE')), (SELECT count(*) FROM RV WHERE type IN ('DOC', 'IDENTIDADE')) UNION ALL SELECT 'edges', (SELECT count(*) FROM E), (SELECT count(*) FROM RE)")
def graph_compare(spark: SparkSession, d: str) -> DataFrame:
    return graph.compare_graphs(whole(spark, d), resolved(spark, d))


_IN_LINKS = ", ".join(f"'{r}'" for r in LINKS)
_PRUNED = f"""L0 AS (SELECT * FROM E WHERE relation IN ({_IN_LINKS})),
 L AS MATERIALIZED (SELECT * FROM L0 WHERE dst IN (SELECT id FROM V WHERE type IN ('LOJA', 'IDENTIDADE', 'DOC')) OR dst IN (SELECT dst FROM L0 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100))"""


def links(spark: SparkSession, d: str) -> graph.PropertyGraph:
    g = graph.prune(whole(spark, d), LINKS)
    cuts = Cuts(spark, "links")
    return graph.PropertyGraph(cuts.put(g.vertices), cuts.put(g.edges))


@R.add(f"WITH {G}, {_PRUNED} SELECT src, dst, relation, qty FROM L")
def graph_prune(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).edges.select("src", "dst", "relation", "qty")


@R.add(f"WITH {G} SELECT src, dst, round(amount, 2) AS amount FROM E WHERE relation = 'pix' AND src LIKE 'DOC:%' AND dst LIKE 'DOC:%'")
def flow_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("relation = 'pix' and src like 'DOC:%' and dst like 'DOC:%'").select("src", "dst", F.round("amount", 2).alias("amount"))


# ---- iterative algorithms ---------------------------------------------------

_FLOW = "F AS MATERIALIZED (SELECT src, dst FROM E WHERE relation = 'pix'), N AS MATERIALIZED (SELECT id FROM V WHERE type = 'DOC'), S AS MATERIALIZED (SELECT src, dst, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY src) AS share FROM F GROUP BY 1, 2)"


def _rank_sql(rounds: int = 10, reset: float = 0.15) -> str:
    out = "r0 AS MATERIALIZED (SELECT id, CAST(1 AS DOUBLE) AS rank FROM N)"
    for i in range(1, rounds + 1):
        out += f", r{i} AS MATERIALIZED (SELECT N.id, {reset} + {1 - reset} * coalesce(m, 0) AS rank FROM N LEFT JOIN (SELECT dst, sum(rank * share) AS m FROM S JOIN r{i - 1} ON r{i - 1}.id = S.src GROUP BY 1) g ON g.dst = N.id)"
    return out


_RANKS = f"{_FLOW}, {_rank_sql()}, ranks AS MATERIALIZED (SELECT id, rank * (SELECT count(*) FROM r10) / (SELECT sum(rank) FROM r10) AS rank FROM r10)"


def flow_ranks(spark: SparkSession, d: str) -> DataFrame:
    g = whole(spark, d)
    return iterate.pagerank(g.vertices.where("type = 'DOC'"), g.edges.where("relation = 'pix'"))


@R.add(f"WITH {G}, {_RANKS} SELECT id, round(rank, 6) AS rank FROM ranks")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return flow_ranks(spark, d).select("id", F.round("rank", 6).alias("rank"))


@R.add(f"WITH {G}, {_RANKS} SELECT E.src AS store, round(max(rank), 6) AS rank FROM E LEFT JOIN ranks ON ranks.id = E.dst WHERE relation = 'titular' GROUP BY 1")
def owner_lift(spark: SparkSession, d: str) -> DataFrame:
    owners = edges(spark, d).where("relation = 'titular'").select(F.col("src").alias("store"), F.col("dst").alias("owner"))
    return features.owner_lift(owners, flow_ranks(spark, d), ["rank"]).select("store", F.round("rank", 6).alias("rank"))


_COMPONENTS = f"{_PRUNED}, B AS MATERIALIZED (SELECT src AS a, dst AS b FROM L UNION SELECT dst, src FROM L), reach(id, component) USING KEY (id) AS (SELECT id, id FROM V UNION SELECT B.b, min(r.component) FROM reach r JOIN B ON B.a = r.id JOIN recurring.reach o ON o.id = B.b WHERE r.component < o.component GROUP BY B.b), members AS MATERIALIZED (SELECT id, component FROM reach)"


@R.add(f"WITH RECURSIVE {G}, {_COMPONENTS} SELECT id, component FROM members")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    g = links(spark, d)
    return iterate.connected_components(g.vertices, g.edges)


_STATS = "cs AS (SELECT component, count(*) AS size, count(CASE WHEN type = 'LOJA' THEN 1 END) AS stores, count(DISTINCT CASE WHEN type = 'LOJA' THEN root END) AS roots, sum(flagged) AS flagged_stores FROM members JOIN V USING (id) GROUP BY 1)"


def members(spark: SparkSession, d: str) -> DataFrame:
    g = links(spark, d)
    return Cuts(spark, "members").put(iterate.connected_components(g.vertices, g.edges).join(g.vertices.select("id", "type", "root", "flagged"), "id"))


@R.add(f"WITH RECURSIVE {G}, {_COMPONENTS}, {_STATS} SELECT component, size, stores, roots, flagged_stores FROM cs")
def component_stats(spark: SparkSession, d: str) -> DataFrame:
    return features.component_statistics(members(spark, d))


@R.add(f"WITH RECURSIVE {G}, {_COMPONENTS}, {_STATS} SELECT m.id AS store, m.component, size, stores, roots, flagged_stores - flagged AS others_flagged FROM members m JOIN V USING (id) JOIN cs ON cs.component = m.component WHERE type = 'LOJA'")
def store_components(spark: SparkSession, d: str) -> DataFrame:
    return features.store_components(members(spark, d))


@R.add(f"WITH {G}, {_PAIRS}, t AS (SELECT x.store_a AS a, x.store_b AS b, y.store_b AS c FROM pairs x JOIN pairs y ON x.store_b = y.store_a JOIN pairs z ON z.store_a = x.store_a AND z.store_b = y.store_b), h AS (SELECT unnest([a, b, c]) AS id FROM t) SELECT V.id, count(h.id) AS triangles FROM V LEFT JOIN h ON h.id = V.id WHERE V.type = 'LOJA' GROUP BY 1")
def triangle_count(spark: SparkSession, d: str) -> DataFrame:
    g = whole(spark, d)
    return iterate.triangle_count(g.vertices.where("type = 'LOJA'"), _pairs(g).select(F.col("store_a").alias("src"), F.col("store_b").alias("dst")))


_HOPS = f"{_PRUNED}, B AS MATERIALIZED (SELECT src AS a, dst AS b FROM L UNION SELECT dst, src FROM L), hop(mark, id, d) AS (SELECT id, id, 0 FROM V WHERE flagged = 1 UNION SELECT mark, B.b, d + 1 FROM hop JOIN B ON B.a = hop.id WHERE d < 48)"


@R.add(f"WITH RECURSIVE {G}, {_HOPS} SELECT V.id, coalesce(m, 99) AS distance FROM V LEFT JOIN (SELECT id, min(d) AS m FROM hop WHERE mark <> id GROUP BY 1) q USING (id) WHERE type = 'LOJA'")
def nearest_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Hops to the nearest other flagged store; the SQL looks 48 hops far, which covers these data."""
    g = links(spark, d)
    return iterate.nearest_other(g.vertices, g.edges, g.vertices.where("flagged = 1")).join(g.vertices.where("type = 'LOJA'").select("id"), "id", "left_semi")


@R.add(f"WITH {G}, {_PAIRS}, b AS (SELECT store_a AS s, store_b AS t FROM pairs UNION ALL SELECT store_b, store_a FROM pairs) SELECT t AS id, count(*) AS neighbors, round(avg(CASE WHEN chargeback_pct > 1 THEN 1.0 ELSE 0 END), 6) AS neighbor_chargeback_rate, round(avg(flagged), 6) AS flagged_neighbor_rate FROM b JOIN V ON V.id = b.s GROUP BY 1")
def aggregate_messages(spark: SparkSession, d: str) -> DataFrame:
    g = whole(spark, d)
    e = graph.symmetric(_pairs(g).select(F.col("store_a").alias("src"), F.col("store_b").alias("dst")))
    got = {"neighbors": F.count(F.lit(1)), "neighbor_chargeback_rate": F.round(F.avg((F.col("src_chargeback_pct") > 1.0).cast("double")), 6), "flagged_neighbor_rate": F.round(F.avg(F.col("src_flagged").cast("double")), 6)}
    return iterate.aggregate_messages(g.vertices, e, got, ["chargeback_pct", "flagged"])


def motif_flag_frames(g: graph.PropertyGraph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stores that share an account, that share a partner with a flagged store, and the cycles through their owners."""
    la = _attributes(g).where("via in ('liquida_em', 'titular>recebe_em')")
    # a store shares an account where the account's stores have more than its own root
    roots = la.where("root is not null").groupBy("attribute").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b")
    account = la.join(roots, "attribute", "left_semi").select("store").distinct()
    partner = graph.partner_of_flagged(g, "socio", own_unflagged=False).select(F.col("a").alias("store")).distinct()
    cyc = graph.cycles3(g.edges.where("relation = 'pix'"), CYCLE3, temporal=False, canonical=False).where("a <> b and b <> c")
    owners = g.edges.where("relation = 'titular'").select(F.col("src").alias("store"), F.col("dst").alias("a"))
    cycles = cyc.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(owners, "a").groupBy("store").agg(F.sum("n").alias("cycles"))
    return account, partner, cycles


_FLAGS = f"""{_ATTR}, acc AS (SELECT DISTINCT a.store FROM la a JOIN la b ON a.attribute = b.attribute AND a.store <> b.store AND a.root <> b.root WHERE a.via IN ('liquida_em', 'titular>recebe_em') AND b.via IN ('liquida_em', 'titular>recebe_em')),
 par AS (SELECT DISTINCT x.src AS store FROM E x JOIN E y ON x.dst = y.dst AND x.src <> y.src JOIN V vb ON vb.id = y.src AND vb.flagged = 1 AND vb.type = 'LOJA' WHERE x.relation = 'socio' AND y.relation = 'socio' AND x.src LIKE 'LOJA:%'),
 p AS ({_LEG.format(CYCLE3)}), cyc AS (SELECT x.src AS a, count(*) AS n FROM p x JOIN p y ON x.dst = y.src JOIN p z ON y.dst = z.src AND z.dst = x.src WHERE x.src <> y.src AND y.src <> z.src AND x.src <> z.src GROUP BY 1),
 cs2 AS (SELECT E.src AS store, sum(n) AS cycles FROM cyc JOIN E ON E.dst = cyc.a AND E.relation = 'titular' GROUP BY 1)"""


@R.add(f"WITH {G}, {_FLAGS} SELECT V.id AS store, CASE WHEN acc.store IS NULL THEN 0 ELSE 1 END AS shares_account, CASE WHEN par.store IS NULL THEN 0 ELSE 1 END AS shares_partner_flagged, coalesce(cs2.cycles, 0) AS cycles FROM V LEFT JOIN acc ON acc.store = V.id LEFT JOIN par ON par.store = V.id LEFT JOIN cs2 ON cs2.store = V.id WHERE V.type = 'LOJA'")
def motif_flags(spark: SparkSession, d: str) -> DataFrame:
    g = whole(spark, d)
    a, p, c = motif_flag_frames(g)
    one = lambda df, n: df.withColumn(n, F.lit(1))
    v = g.vertices.where("type = 'LOJA'").select(F.col("id").alias("store"))
    return v.join(one(a, "shares_account"), "store", "left").join(one(p, "shares_partner_flagged"), "store", "left").join(c, "store", "left").fillna(0)


def _ppr_sql(rounds: int = 10, reset: float = 0.15) -> str:
    out = "q0 AS MATERIALIZED (SELECT id, CAST(flagged AS DOUBLE) AS start, CAST(flagged AS DOUBLE) AS rank FROM V)"
    for i in range(1, rounds + 1):
        out += f", q{i} AS MATERIALIZED (SELECT b.id, b.start, {reset} * b.start + {1 - reset} * coalesce(m, 0) AS rank FROM q0 b LEFT JOIN (SELECT T.t AS id, sum(rank * share) AS m FROM T JOIN q{i - 1} x ON x.id = T.s GROUP BY 1) g USING (id))"
    return out


@R.add(f"WITH {G}, {_PRUNED}, T0 AS (SELECT src AS s, dst AS t FROM L UNION ALL SELECT dst, src FROM L), T AS MATERIALIZED (SELECT s, t, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY s) AS share FROM T0 GROUP BY 1, 2), {_ppr_sql()} SELECT q.id, round(rank, 6) AS rank FROM q10 q JOIN V USING (id) WHERE type = 'LOJA' AND flagged = 0")
def ppr(spark: SparkSession, d: str) -> DataFrame:
    """Personalised ranks from all flagged stores summed, of the unflagged ones."""
    g = links(spark, d)
    r = iterate.personalized_pagerank(g.vertices, graph.symmetric(g.edges), g.vertices.where("flagged = 1"))
    return r.join(g.vertices.where("type = 'LOJA' and flagged = 0").select("id"), "id", "left_semi").select("id", F.round("rank", 6).alias("rank"))


@R.add()
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Communities over links and payments; a label is checked by tests on small graphs."""
    g = links(spark, d)
    flow = edges(spark, d).where("relation = 'pix'").select("src", "dst")
    return iterate.label_propagation(g.vertices, g.edges.select("src", "dst").unionByName(flow))


def feature_frames(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Stores and every graph feature per store."""
    cuts = Cuts(spark, "features")
    g = whole(spark, d)
    g = graph.PropertyGraph(cuts.put(g.vertices), g.edges)
    pairs = cuts.put(_pairs(g))
    stores = g.vertices.where("type = 'LOJA'").select(F.col("id").alias("store"))
    own = g.edges.where("relation in ('liquida_em', 'socio')").groupBy(F.col("src").alias("store")).agg(F.countDistinct(F.when(F.col("relation") == "liquida_em", F.col("dst"))).alias("accounts"), F.countDistinct(F.when(F.col("relation") == "socio", F.col("dst"))).alias("partners"))
    owners = g.edges.where("relation = 'titular'").select(F.col("src").alias("store"), F.col("dst").alias("owner"))
    both = graph.symmetric(pairs.select(F.col("store_a").alias("src"), F.col("store_b").alias("dst")))
    near = iterate.aggregate_messages(g.vertices, both, {"neighbors": F.count(F.lit(1)), "neighbor_chargeback_rate": F.avg((F.col("src_chargeback_pct") > 1.0).cast("double")), "flagged_neighbor_rate": F.avg(F.col("src_flagged").cast("double"))}, ["chargeback_pct", "flagged"])
    a, p, c = motif_flag_frames(g)
    at = lambda df: df.withColumnRenamed("id", "store")
    one = lambda df, n: df.withColumn(n, F.lit(1))
    return stores, {
        "degree": at(graph.degrees(g.edges)).select("store", "degree"), "own": own, "rank": features.owner_lift(owners, flow_ranks(spark, d), ["rank"]), "component": features.store_components(members(spark, d)),
        "triangles": at(iterate.triangle_count(g.vertices.where("type = 'LOJA'"), pairs.select(F.col("store_a").alias("src"), F.col("store_b").alias("dst")))), "distance": at(nearest_flagged(spark, d)),
        "near": at(near), "account": one(a, "shares_account"), "partner": one(p, "shares_partner_flagged"), "cycles": c,
    }


def assembled(spark: SparkSession, d: str) -> DataFrame:
    stores, parts = feature_frames(spark, d)
    return Cuts(spark, "assembled").put(features.assemble(stores, parts))


_FEATURES = f"""{_RANKS}, {_COMPONENTS}, {_STATS}, {_FLAGS.replace(_ATTR, _PAIRS)},
 deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM E UNION ALL SELECT dst FROM E) GROUP BY 1),
 ow AS (SELECT src AS id, count(DISTINCT CASE WHEN relation = 'liquida_em' THEN dst END) AS accounts, count(DISTINCT CASE WHEN relation = 'socio' THEN dst END) AS partners FROM E WHERE relation IN ('liquida_em', 'socio') GROUP BY 1),
 lift AS (SELECT E.src AS id, max(rank) AS rank FROM E LEFT JOIN ranks ON ranks.id = E.dst WHERE relation = 'titular' GROUP BY 1)"""


@R.add(f"WITH RECURSIVE {G}, {_FEATURES} SELECT V.id AS store, coalesce(degree, 0) AS degree, coalesce(accounts, 0) AS accounts, coalesce(partners, 0) AS partners, round(coalesce(rank, 0), 6) AS rank, cs.size, cs.stores, cs.roots, cs.flagged_stores - V.flagged AS others_flagged, CASE WHEN acc.store IS NULL THEN 0 ELSE 1 END AS shares_account, coalesce(cs2.cycles, 0) AS cycles FROM V LEFT JOIN deg USING (id) LEFT JOIN ow USING (id) LEFT JOIN lift USING (id) JOIN members m USING (id) JOIN cs ON cs.component = m.component LEFT JOIN acc ON acc.store = V.id LEFT JOIN cs2 ON cs2.store = V.id WHERE V.type = 'LOJA'")
def graph_features(spark: SparkSession, d: str) -> DataFrame:
    f = assembled(spark, d)
    return f.select("store", "degree", "accounts", "partners", F.round("rank", 6).alias("rank"), "size", "stores", "roots", "others_flagged", "shares_account", "cycles")


@R.add(f"WITH RECURSIVE {G}, {_FEATURES} SELECT V.flagged, round(avg(coalesce(degree, 0)), 3) AS degree, round(avg(cs.stores), 3) AS stores, round(avg(CASE WHEN acc.store IS NULL THEN 0 ELSE 1 END), 3) AS shares_account FROM V LEFT JOIN deg USING (id) JOIN members m USING (id) JOIN cs ON cs.component = m.component LEFT JOIN acc ON acc.store = V.id WHERE V.type = 'LOJA' GROUP BY 1")
def class_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of graph features of flagged and other stores."""
    f = assembled(spark, d).join(vertices(spark, d).select(F.col("id").alias("store"), "flagged"), "store")
    return features.class_means(f, "flagged", ["degree", "stores", "shares_account"])


@R.add()
def community_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per store: stores of its community, their mean chargeback and flagged ones, itself left out."""
    from riskweave.operators.relational import leave_one_out

    lab = label_propagation(spark, d).join(vertices(spark, d).where("type = 'LOJA'").select("id", "flagged", "chargeback_pct"), "id")
    n = lab.groupBy("label").agg(F.count(F.lit(1)).alias("community_stores"), F.sum("flagged").alias("_f"))
    x = leave_one_out(lab, ["label"], "chargeback_pct", "community_chargeback").join(n, "label")
    return x.select(F.col("id").alias("store"), "community_stores", "community_chargeback", (F.col("_f") - F.col("flagged")).alias("community_flagged"))


R.typed("edge_stats", qty="BIGINT")
R.typed("degrees", in_degree="BIGINT", out_degree="BIGINT")
R.typed("graph_resolve", qty="BIGINT")
R.typed("component_stats", flagged_stores="BIGINT")
R.typed("store_components", others_flagged="BIGINT")
R.typed("motif_flags", cycles="BIGINT")
R.typed("graph_features", others_flagged="BIGINT", cycles="BIGINT")
