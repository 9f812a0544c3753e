"""Network view: people projected on stores, attribute levels, flows, signals, labels.

Input rows are edges with both ends' type, name and flag (see
``serve.network``); a view is that of one root store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.operators.graph import cycles3

#: Stands for all people that belong to no store.
NO_STORE = "no_store"
# Shown names of relations.
RELATION_LABELS = {
    "titular": "titular", "socio": "sócio/responsável", "liquida_em": "liquida na conta", "localizada_em": "está no endereço", "recebe_em": "recebe PIX na conta", "paga_com": "paga PIX com a conta",
    "tem_telefone": "usa o telefone", "tem_email": "usa o e-mail", "usa_dispositivo": "usa o dispositivo", "pix": "enviou PIX para",
}
# Shown names of vertex types.
TYPE_LABELS = {
    "LOJA": "Loja", "GRUPO": "Pessoas sem loja", "IDENTIDADE": "Pessoa / empresa", "DOC": "Pessoa / empresa", "CONTA": "Conta bancária", "TELEFONE": "Telefone", "EMAIL": "E-mail", "ENDERECO": "Endereço", "DISPOSITIVO": "Dispositivo",
}
# Shown names of features and whether they come from the graph.
SIGNAL_LABELS = {
    "turnover": ("Faturamento", False), "turnover_to_mean": ("Faturamento acima da média histórica", False), "turnover_cv": ("Faturamento instável", False), "cnp_pct": ("Concentração em venda não presencial", False),
    "chargeback_pct": ("Chargeback alto", False), "cancel_pct": ("Cancelamentos altos", False), "ticket": ("Ticket médio atípico", False), "age_days": ("Afiliação recente", False), "advance_pct": ("Antecipação agressiva", False),
    "pep": ("Sócio PEP", False), "ownership_change": ("Alteração societária", False), "alert": ("Alerta comportamental", False), "irregular_partner": ("Sócio irregular na Receita", False), "ecommerce": ("E-commerce", False),
    "high_risk_industry": ("Ramo de alto risco PLD", False), "card_count": ("Volume de transações", False), "night_rate": ("Transações de madrugada", False), "below_limit_rate": ("Fracionamento abaixo de limites", False),
    "round_amount_rate": ("Valores redondos", False), "prepaid_rate": ("Cartões pré-pagos", False), "not_present_rate": ("Cartão não presente", False), "rule_fired_rate": ("Regras PLD acionadas", False),
    "score_mean": ("Score elevado", False), "foreign_rate": ("Cartões estrangeiros", False), "payment_count": ("Volume de PIX", False), "mule_marks_mean": ("Pagadores marcados como laranja", False),
    "young_account_rate": ("PIX de contas recém-abertas", False), "advance_count": ("Muitas antecipações", False), "degree": ("Muitas conexões", True), "accounts": ("Várias contas de liquidação", True), "partners": ("Vários sócios/responsáveis", True),
    "rank": ("Central no fluxo de dinheiro", True), "in_degree": ("Muitos pagadores PIX", True), "out_degree": ("Muitos destinos PIX", True), "size": ("Grupo de vínculos grande", True), "stores": ("Várias lojas no mesmo grupo", True),
    "roots": ("Lojas de CNPJs diferentes ligadas", True), "others_flagged": ("Grupo com fraude confirmada", True), "community_stores": ("Comunidade grande", True), "community_chargeback": ("Comunidade com chargeback alto", True),
    "community_flagged": ("Comunidade com fraude confirmada", True), "triangles": ("Lojas interligadas (triângulos)", True), "distance": ("Perto de loja fraudada", True), "neighbors": ("Muitas lojas vizinhas", True),
    "neighbor_chargeback_rate": ("Vizinhos com chargeback alto", True), "flagged_neighbor_rate": ("Vizinhos com fraude", True), "shares_account": ("Conta compartilhada com outra loja", True),
    "shares_partner_flagged": ("Sócio em comum com loja fraudada", True), "cycles": ("Ciclos de PIX", True),
}


def _lookup(values: dict[str, str], c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c], c)


def relation_label(c: Column) -> Column:
    return _lookup(RELATION_LABELS, c)


def type_label(c: Column) -> Column:
    return _lookup(TYPE_LABELS, c)


def attribute_label(kind: Column, name: Column) -> Column:
    """Accounts as branch / number, devices by eight letters, phones in groups; others as they are."""
    part = F.split(name, r"\|")
    account = F.when((F.coalesce(F.get(part, 1), F.lit("")) != "") & (F.coalesce(F.get(part, 2), F.lit("")) != ""), F.concat(F.lit("Conta "), F.get(part, 1), F.lit(" / "), F.get(part, 2))).otherwise(F.concat(F.lit("Conta "), name))
    phone = F.when(name.rlike(r"^\+55\d{10,11}$"), F.regexp_replace(name, r"^\+55(\d{2})(\d{4,5})(\d{4})$", "+55 $1 $2-$3")).otherwise(name)
    return F.when(kind == "CONTA", account).when(kind == "DISPOSITIVO", F.concat(F.lit("Dispositivo "), F.substring(name, 1, 8))).when(kind == "TELEFONE", phone).otherwise(name)


def signal_labels(c: Column) -> Column:
    """array<struct<label, from_graph>> of a comma-separated list of features; unknown ones show as they are; null gives an empty list."""
    names = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    label = F.create_map(*[F.lit(x) for k, v in SIGNAL_LABELS.items() for x in (k, v[0])])
    graph = F.create_map(*[F.lit(x) for k, v in SIGNAL_LABELS.items() for x in (k, v[1])])
    return F.transform(names, lambda n: F.struct(F.coalesce(label[n], n).alias("label"), F.coalesce(graph[n], F.lit(False)).alias("from_graph")))


def view_vertices(rows: DataFrame) -> DataFrame:
    """id, type, name, flagged: each end once; of differing rows the least attributes."""
    ends = [rows.select(F.col(e).alias("id"), F.struct(F.col(f"{e}_type").alias("type"), F.col(f"{e}_name").alias("name"), F.col(f"{e}_flagged").alias("flagged")).alias("_v")) for e in ("src", "dst")]
    return ends[0].unionByName(ends[1]).groupBy("id").agg(F.min("_v").alias("_v")).select("id", "_v.*")


def person_stores(rows: DataFrame) -> DataFrame:
    """person, store, role: owner before partner."""
    e = rows.where("src_type = 'LOJA' and relation in ('titular', 'socio')")
    return e.groupBy(F.col("dst").alias("person"), F.col("src").alias("store")).agg(F.when(F.max((F.col("relation") == "titular").cast("int")) == 1, "titular").otherwise("sócio").alias("role"))


def projected_links(rows: DataFrame) -> DataFrame:
    """source, target, labels, people: links of people moved to each of their stores, else to the group without store.

    ``people`` counts the people without store behind a group's link.
    """
    e = rows.where("relation <> 'pix'").join(person_stores(rows).withColumnRenamed("person", "src"), "src", "left")
    own = F.col("src_type") == "LOJA"
    source = F.when(own, F.col("src")).otherwise(F.coalesce("store", F.lit(NO_STORE)))
    label = F.when(own | F.col("role").isNull(), relation_label(F.col("relation"))).otherwise(F.concat_ws(" ", "role", relation_label(F.col("relation"))))
    e = e.select(source.alias("source"), F.col("dst").alias("target"), label.alias("label"), F.when(source == NO_STORE, F.col("src")).alias("person"))
    return e.groupBy("source", "target").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.countDistinct("person").alias("people"))


def attribute_levels(rows: DataFrame) -> DataFrame:
    """target, stores, people, flagged_stores, level: normal under two users, fraude with a flagged store, else alerta."""
    v = view_vertices(rows).select(F.col("id").alias("source"), "flagged")
    links = projected_links(rows).join(v, "source", "left")
    store = F.col("source") != NO_STORE
    g = links.groupBy("target").agg(F.sum(store.cast("long")).alias("stores"), F.sum("people").alias("people"), F.sum((store & (F.coalesce("flagged", F.lit(0)) == 1)).cast("long")).alias("flagged_stores"))
    return g.withColumn("level", F.when(F.col("stores") + F.col("people") < 2, "normal").when(F.col("flagged_stores") > 0, "fraude").otherwise("alerta"))


def visible_attributes(levels: DataFrame, complete: bool) -> DataFrame:
    """Attributes that are shown: any level but normal; in complete mode also those of a store."""
    return levels.where((F.col("level") != "normal") | (F.lit(complete) & (F.col("stores") >= 1)))


def hidden_count(levels: DataFrame, complete: bool) -> DataFrame:
    return levels.where((F.col("level") == "normal") & ~F.lit(complete) & (F.col("stores") >= 1)).agg(F.count(F.lit(1)).alias("hidden"))


def main_entity(rows: DataFrame, root: str) -> DataFrame:
    """person, entity: the root store where it is one of the person's, else the least; people without store are absent."""
    return person_stores(rows).groupBy("person").agg(F.coalesce(F.max(F.when(F.col("store") == root, F.col("store"))), F.min("store")).alias("entity"))


def _entities(rows: DataFrame, root: str) -> DataFrame:
    flow = rows.where("relation = 'pix'")
    own = main_entity(rows, root)
    for end in ("src", "dst"):
        flow = flow.join(own.select(F.col("person").alias(end), F.col("entity").alias(f"_{end}")), end, "left")
        flow = flow.withColumn(f"_{end}", F.when(F.col(f"{end}_type") == "LOJA", F.col(end)).otherwise(F.coalesce(f"_{end}", F.lit(NO_STORE))))
    return flow


def flow_cycles(rows: DataFrame) -> DataFrame:
    """a, b, c: directed 3-cycles of the money flow, each unordered triple once."""
    e = rows.where("relation = 'pix'").select("src", "dst", F.lit(1.0).alias("amount"), F.lit(None).cast("timestamp").alias("ts_min"), F.lit(None).cast("timestamp").alias("ts_max")).distinct()
    t = cycles3(e, 0.0, temporal=False, canonical=False).where("a <> b and b <> c")
    k = F.array_sort(F.array("a", "b", "c"))
    return t.select(k[0].alias("a"), k[1].alias("b"), k[2].alias("c")).distinct()


def pair_flows(rows: DataFrame, root: str) -> DataFrame:
    """a, b, ab, ba, qty, in_cycle, source, target, both_ways per pair of entities with flow between them.

    The greater flow gives the direction, a to b where they are equal.
    """
    c = flow_cycles(rows)
    legs = None
    for x in "abc":
        for y in "abc":
            if x != y:
                one = c.select(F.col(x).alias("src"), F.col(y).alias("dst"))
                legs = one if legs is None else legs.unionByName(one)
    legs = legs.distinct().withColumn("_c", F.lit(True))
    f = _entities(rows, root).join(legs, ["src", "dst"], "left").where("_src <> _dst")
    s, t = F.col("_src"), F.col("_dst")
    g = f.groupBy(F.least(s, t).alias("a"), F.greatest(s, t).alias("b")).agg(
        F.sum(F.when(s < t, F.col("amount")).otherwise(0.0)).alias("ab"), F.sum(F.when(s > t, F.col("amount")).otherwise(0.0)).alias("ba"), F.sum("qty").alias("qty"), F.coalesce(F.max("_c"), F.lit(False)).alias("in_cycle"),
    )
    fwd = F.col("ab") >= F.col("ba")
    return g.select("*", F.when(fwd, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(fwd, F.col("b")).otherwise(F.col("a")).alias("target"), ((F.col("ab") > 0) & (F.col("ba") > 0)).alias("both_ways"))


def flow_totals(rows: DataFrame, root: str) -> DataFrame:
    """entity, sent, received; the flow inside the group without store is its own ``internal`` row value."""
    f = _entities(rows, root)
    out = f.where("_src <> _dst").select(F.col("_src").alias("entity"), F.col("amount").alias("sent"), F.lit(0.0).alias("received"), F.lit(0.0).alias("internal"))
    inn = f.where("_src <> _dst").select(F.col("_dst").alias("entity"), F.lit(0.0).alias("sent"), F.col("amount").alias("received"), F.lit(0.0).alias("internal"))
    own = f.where((F.col("_src") == F.col("_dst")) & (F.col("_src") == NO_STORE)).select(F.col("_src").alias("entity"), F.lit(0.0).alias("sent"), F.lit(0.0).alias("received"), F.col("amount").alias("internal"))
    return out.unionByName(inn).unionByName(own).groupBy("entity").agg(*[F.sum(c).alias(c) for c in ("sent", "received", "internal")])


def store_order(rows: DataFrame, root: str, scores: DataFrame | None = None) -> DataFrame:
    """store, place: the root, flagged stores, then by score descending; ties by id. One view is bounded by its row limit."""
    v = view_vertices(rows).where("type = 'LOJA'")
    v = v.join(scores.select(F.col("id"), "score"), "id", "left") if scores is not None else v.withColumn("score", F.lit(None).cast("double"))
    w = W.orderBy(F.desc(F.col("id") == root), F.desc("flagged"), F.desc(F.coalesce("score", F.lit(0.0))), "id")
    return v.select(F.col("id").alias("store"), (F.row_number().over(w) - 1).alias("place"))


def attribute_order(rows: DataFrame, root: str, complete: bool) -> DataFrame:
    """target, place: shared before exclusive, then by the mean place of the linked stores, then graver levels."""
    order = store_order(rows, root)
    last = order.agg(F.count(F.lit(1)).alias("place")).select(F.lit(NO_STORE).alias("source"), "place")
    at = order.withColumnRenamed("store", "source").unionByName(last)
    mean = projected_links(rows).join(at, "source").groupBy("target").agg(F.avg("place").alias("mean"))
    grave = F.when(F.col("level") == "fraude", 0).when(F.col("level") == "alerta", 1).otherwise(2)
    w = W.orderBy((F.col("level") == "normal").cast("int"), "mean", grave, "target")
    return visible_attributes(attribute_levels(rows), complete).join(mean, "target").select("target", (F.row_number().over(w) - 1).alias("place"))


def link_levels(rows: DataFrame, root: str) -> DataFrame:
    """source, target, level: fraude where the attribute is and the source is flagged or the root; normal with the attribute; else alerta."""
    v = view_vertices(rows).select(F.col("id").alias("source"), "flagged")
    j = projected_links(rows).join(attribute_levels(rows).select("target", F.col("level").alias("_l")), "target").join(v, "source", "left")
    grave = (F.col("_l") == "fraude") & ((F.coalesce("flagged", F.lit(0)) == 1) & (F.col("source") != NO_STORE) | (F.col("source") == root))
    return j.select("source", "target", F.when(grave, "fraude").when(F.col("_l") == "normal", "normal").otherwise("alerta").alias("level"))


def shared_kinds(rows: DataFrame) -> DataFrame:
    """store, kinds: shown names of the kinds of attribute a store shares."""
    kind = view_vertices(rows).select(F.col("id").alias("target"), F.when(F.col("type").isin("DOC", "IDENTIDADE"), "Titular/sócio").otherwise(type_label(F.col("type"))).alias("kind"))
    shared = attribute_levels(rows).where("level <> 'normal'").select("target")
    return projected_links(rows).where(F.col("source") != NO_STORE).join(shared, "target").join(kind, "target").groupBy(F.col("source").alias("store")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def signals(rows: DataFrame, root: str) -> DataFrame:
    """level, about, target, stores, people, amount, of_root: what is remarkable, gravest first.

    Shared attributes; the three greatest flows with a flagged store; cycles;
    the whole flow. Rows are facts, texts are made from them by the labels.
    """
    v = view_vertices(rows)
    flagged = v.where("type = 'LOJA' and flagged = 1").select("id")
    has_root = projected_links(rows).groupBy("target").agg(F.max((F.col("source") == root).cast("int")).alias("of_root"))
    a = attribute_levels(rows).where("level <> 'normal'").join(has_root, "target").select("level", F.lit("attribute").alias("about"), "target", "stores", "people", F.lit(None).cast("double").alias("amount"), "of_root")
    f = pair_flows(rows, root).withColumn("amount", F.col("ab") + F.col("ba"))
    touch = f.join(flagged.withColumnRenamed("id", "a"), "a", "left_semi").unionByName(f.join(flagged.withColumnRenamed("id", "b"), "b", "left_semi")).distinct()
    touch = touch.orderBy(F.desc("amount"), "a", "b").limit(3)
    b = touch.select(F.lit("fraude").alias("level"), F.lit("flow").alias("about"), F.concat_ws("~", "a", "b").alias("target"), F.lit(None).cast("long").alias("stores"), F.lit(None).cast("long").alias("people"), "amount", ((F.col("a") == root) | (F.col("b") == root)).cast("int").alias("of_root"))
    c = flow_cycles(rows).agg(F.count(F.lit(1)).cast("double").alias("amount")).where("amount > 0").select(F.lit("alerta").alias("level"), F.lit("cycles").alias("about"), F.lit(root).alias("target"), F.lit(None).cast("long").alias("stores"), F.lit(None).cast("long").alias("people"), "amount", F.lit(1).alias("of_root"))
    d = rows.where("relation = 'pix'").agg(F.sum("amount").alias("amount")).where("amount > 0").select(F.lit("alerta").alias("level"), F.lit("total_flow").alias("about"), F.lit(root).alias("target"), F.lit(None).cast("long").alias("stores"), F.lit(None).cast("long").alias("people"), "amount", F.lit(1).alias("of_root"))
    grave = F.when(F.col("level") == "fraude", 0).otherwise(1)
    return a.unionByName(b).unionByName(c).unionByName(d).orderBy(grave, F.desc("of_root"), "about", "target")
