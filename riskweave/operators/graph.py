"""Property graphs over two frames: building, counting, motifs, resolution, pruning.

Vertices have ``id``; edges ``src``, ``dst``, ``relation``, ``qty``, ``amount``,
``ts_min``, ``ts_max``. Everything is lazy and stays in Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Id prefixes and vertex types.
VERTEX_TYPES = {"LOJA": "LOJA", "DOC": "DOC", "CONTA": "CONTA", "TEL": "TELEFONE", "EMAIL": "EMAIL", "END": "ENDERECO", "DISP": "DISPOSITIVO", "CARTAO": "CARTAO", "IDN": "IDENTIDADE"}
EDGE_COLUMNS = ["src", "dst", "relation", "qty", "amount", "ts_min", "ts_max"]


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame

    def relations(self, *names: str) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.where(F.col("relation").isin(*names)))

    def where(self, edges: str | Column) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.where(edges))

    def symmetric(self) -> PropertyGraph:
        return PropertyGraph(self.vertices, symmetric(self.edges))


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, attributes kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def build_edges(df: DataFrame, src: Column, dst: Column, relation: str, amount: Column | None = None, at: Column | None = None) -> DataFrame:
    """Edges of one source: null ends and loops dropped, then counted and summed per pair.

    The aggregation is partial before the shuffle, so a hot pair or hot end is one state per task.
    """
    e = df.select(src.alias("src"), dst.alias("dst"), (amount if amount is not None else F.lit(None)).cast("double").alias("_v"), (at if at is not None else F.lit(None)).cast("timestamp").alias("_t"))
    e = e.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("qty"), F.sum("_v").alias("amount"), F.min("_t").alias("ts_min"), F.max("_t").alias("ts_max")).withColumn("relation", F.lit(relation)).select(EDGE_COLUMNS)


def regroup(edges: DataFrame) -> DataFrame:
    """One row per source, target and relation."""
    return edges.groupBy("src", "dst", "relation").agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def id_type(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in VERTEX_TYPES.items() for x in kv])[F.substring_index(c, ":", 1)]


def id_value(c: Column) -> Column:
    return F.expr(f"substring({_name(c)}, instr({_name(c)}, ':') + 1)")


def _name(c: Column) -> str:
    return c._jc.toString()


def complete_vertices(known: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Known vertices first, then every other end of an edge with type and name from its id (or from ``names``: value, name)."""
    other = endpoints(edges).join(known.select("id"), "id", "left_anti").select("id", id_type(F.col("id")).alias("type"), id_value(F.col("id")).alias("value"))
    if names is not None:
        other = other.join(names, "value", "left")
    label = F.coalesce("name", "value") if names is not None else F.col("value")
    root = F.when(F.col("type") == "DOC", F.when(F.length("value") == 14, F.substring("value", 1, 8)).otherwise(F.col("value")))
    have = {"id": F.col("id"), "type": F.col("type"), "name": label, "root": root, "flagged": F.lit(0)}
    return known.unionByName(other.select(*[have[c].alias(c) for c in known.columns if c in have], *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns if c not in have]))


def orphan_ends(g: PropertyGraph) -> DataFrame:
    """Ends of edges without a vertex; a sound graph has none."""
    return endpoints(g.edges).join(g.vertices.select("id"), "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree, in_degree, out_degree in edge rows; vertices without edges are absent."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def neighborhood(edges: DataFrame, vertex: str, without: Sequence[str] = ()) -> DataFrame:
    """Edges at a vertex in either direction, without the relations named."""
    e = edges.where(~F.col("relation").isin(*without)) if without else edges
    return e.where((F.col("src") == vertex) | (F.col("dst") == vertex))


_TERM = re.compile(r"^\((\w+)\)-\[(\w+)\]->\((\w+)\)$")


def find(edges: DataFrame, pattern: str, where: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Matches of a motif: terms ``(a)-[e]->(b)`` joined by ``;``, equal names meaning one vertex.

    Output: a column per vertex name (its id) and ``<edge>_<column>`` for each
    column in ``carry``. Conditions are SQL over these; each is applied with the
    first term that binds all its names, so it prunes before the next join.
    Different names may bind one vertex unless a condition says otherwise.
    """
    terms = [t.strip() for t in pattern.split(";") if t.strip()]
    parsed = []
    for t in terms:
        m = _TERM.match(t)
        if not m:
            raise ValueError(f"not a motif term: {t}")
        parsed.append(m.groups())
    left = list(where)
    out: DataFrame | None = None
    bound: set[str] = set()
    for a, e, b in parsed:
        same = edges.where("src = dst") if a == b else edges
        t = same.select(F.col("src").alias(a), *([] if a == b else [F.col("dst").alias(b)]), *[F.col(c).alias(f"{e}_{c}") for c in carry])
        new = {a, b, *(f"{e}_{c}" for c in carry)}
        # conditions on this term alone come before the join
        ready = [w for w in left if _names(w) <= new]
        for w in ready:
            t = t.where(w)
        left = [w for w in left if w not in ready]
        if out is None:
            out = t
        else:
            shared = sorted({a, b} & bound)
            if not shared:
                raise ValueError(f"term shares no vertex with those before: ({a})-[{e}]->({b})")
            out = out.join(t, shared)
        bound |= new
        ready = [w for w in left if _names(w) <= bound]
        for w in ready:
            out = out.where(w)
        left = [w for w in left if w not in ready]
    if left:
        raise ValueError(f"unbound names in {left}")
    return out


_WORDS = {"and", "or", "not", "in", "is", "null", "between", "like"}


def _names(condition: str) -> set[str]:
    bare = re.sub(r"'[^']*'", "", condition)
    return {w for w in re.findall(r"\b[a-z_]\w*\b", bare) if w not in _WORDS}


def with_vertex(df: DataFrame, name: str, vertices: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attaches columns of the vertex a name is bound to, as ``<name>_<column>``; matches without the vertex vanish."""
    return df.join(vertices.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns]), name)


def shared_targets(g: PropertyGraph, relation: str) -> DataFrame:
    """Unordered pairs of stores of different roots that point at one vertex: a, b, c."""
    stores = g.vertices.where("type = 'LOJA' and root is not null").select("id", "root")
    # root and type come with the edge, so both conditions prune in the self-join
    e = g.edges.where(F.col("relation") == relation).join(stores.withColumnRenamed("id", "src"), "src")
    m = find(e, "(a)-[e1]->(c); (b)-[e2]->(c)", ["a < b", "e1_root <> e2_root"], ["root"])
    return m.select("a", "b", "c")


def partner_of_flagged(g: PropertyGraph, relation: str, own_unflagged: bool = True) -> DataFrame:
    """Pairs (a, b, c): stores that share a vertex with a flagged store b."""
    v = g.vertices.where("type = 'LOJA'").select("id", "flagged")
    e = g.edges.where(F.col("relation") == relation).join(v.withColumnRenamed("id", "src"), "src")
    where = ["a <> b", "e2_flagged = 1"] + (["e1_flagged = 0"] if own_unflagged else [])
    return find(e, "(a)-[e1]->(c); (b)-[e2]->(c)", where, ["flagged"]).select("a", "b", "c")


def cycles3(edges: DataFrame, least: float, temporal: bool = True, canonical: bool = True) -> DataFrame:
    """Directed 3-cycles over edges of at least an amount.

    Canonical: each cycle once, from its least vertex; else all rotations.
    Temporal: each leg begins no later than the next ends.
    """
    e = edges.where(F.col("amount") >= least).select("src", "dst", "amount", "ts_min", "ts_max").where("src <> dst")
    where = ["a < b", "a < c"] if canonical else ["a <> c"]
    if temporal:
        where += ["e1_ts_min <= e2_ts_max", "e2_ts_min <= e3_ts_max"]
    return find(e, "(a)-[e1]->(b); (b)-[e2]->(c); (c)-[e3]->(a)", where, ["amount", "ts_min", "ts_max"])


def cycles4(edges: DataFrame, least: float) -> DataFrame:
    """Directed 4-cycles from their least vertex, opposite corners distinct."""
    e = edges.where(F.col("amount") >= least).select("src", "dst").where("src <> dst")
    return find(e, "(a)-[e1]->(b); (b)-[e2]->(c); (c)-[e3]->(d); (d)-[e4]->(a)", ["a < b", "a < c", "a < d", "b <> d"]).select("a", "b", "c", "d")


def store_attributes(g: PropertyGraph, direct: Sequence[str], via_owner: Sequence[str], most_stores: int = 50) -> DataFrame:
    """(store, root, attribute, via): attributes of stores, own and their owner's, without those of more than ``most_stores`` stores.

    The bound is the operator's definition of a generic attribute, not a cut of the data.
    """
    stores = g.vertices.where("type = 'LOJA'").select(F.col("id").alias("store"), "root")
    own = g.edges.where(F.col("relation").isin(*direct)).select(F.col("src").alias("store"), F.col("dst").alias("attribute"), F.col("relation").alias("via"))
    owner = g.edges.where("relation = 'titular'").select(F.col("src").alias("store"), F.col("dst").alias("owner"))
    his = g.edges.where(F.col("relation").isin(*via_owner)).select(F.col("src").alias("owner"), F.col("dst").alias("attribute"), F.col("relation").alias("via"))
    two = owner.join(his, "owner").select("store", "attribute", F.concat(F.lit("titular>"), "via").alias("via"))
    all_ = own.unionByName(two).join(stores, "store").distinct()
    few = all_.groupBy("attribute").agg(F.countDistinct("store").alias("_n")).where(F.col("_n") <= most_stores).select("attribute")
    return all_.join(few, "attribute").select("store", "root", "attribute", "via")


def store_pairs(attributes: DataFrame) -> DataFrame:
    """store_a, store_b, attributes, via: pairs of stores of different roots with their shared attributes."""
    a, b = (attributes.select("attribute", F.col("store").alias(f"store_{s}"), F.col("root").alias(f"root_{s}"), F.col("via").alias(f"via_{s}")) for s in "ab")
    j = a.join(b, "attribute").where("store_a < store_b and root_a <> root_b")
    return j.groupBy("store_a", "store_b").agg(F.countDistinct("attribute").alias("attributes"), F.array_sort(F.collect_set("via_a")).alias("via"))


def linked_store_rank(pairs: DataFrame) -> DataFrame:
    """store, linked_stores, via: stores by the number of others they are linked with."""
    both = pairs.select(F.col("store_a").alias("store"), F.col("store_b").alias("other"), "via").unionByName(pairs.select(F.col("store_b").alias("store"), F.col("store_a").alias("other"), "via"))
    return both.groupBy("store").agg(F.countDistinct("other").alias("linked_stores"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("via")))).alias("via"))


def same_name_one_edit(named: DataFrame, key: str, name: str) -> DataFrame:
    """Pairs of keys under one name that are one edit apart.

    Keys of one name meet by shared deletion keys, never all with all.
    """
    cut = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substring(F.col(key), F.lit(1), i - 1), F.substring(F.col(key), i + 1, F.length(key))))
    k = named.where(F.col(name).isNotNull() & F.col(key).isNotNull()).select(name, F.col(key).alias("_x"), F.explode(F.array_distinct(F.concat(F.array(F.col(key)), cut))).alias("_k"))
    a, b = k.select(name, "_k", F.col("_x").alias("key_a")), k.select(name, "_k", F.col("_x").alias("key_b"))
    return a.join(b, [name, "_k"]).where((F.col("key_a") < F.col("key_b")) & (F.levenshtein("key_a", "key_b", 1) == 1)).select(name, "key_a", "key_b").distinct()


def resolve(g: PropertyGraph, mapping: DataFrame) -> PropertyGraph:
    """Ends mapped to their identity (id, to), unmapped ones kept; new loops dropped; edges regrouped.

    An identity's vertex takes the least name and root of its members.
    """
    m = mapping.where("id is not null and to is not null").groupBy("id").agg(F.min("to").alias("to"))
    e = g.edges
    for end in ("src", "dst"):
        e = e.join(m.select(F.col("id").alias(end), F.col("to").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    e = regroup(e.where("src <> dst"))
    v = g.vertices.join(m, "id", "left")
    rest = [c for c in g.vertices.columns if c not in ("id", "type")]
    whole = v.where("to is not null").groupBy("to").agg(*[F.min(c).alias(c) for c in rest]).select(F.col("to").alias("id"), F.lit("IDENTIDADE").alias("type"), *rest)
    return PropertyGraph(v.where("to is null").select(*g.vertices.columns).unionByName(whole.select(*g.vertices.columns)), e)


def compare_graphs(before: PropertyGraph, after: PropertyGraph) -> DataFrame:
    """metric, before, after: vertices, people, edges."""
    rows = None
    for name, of in (("vertices", lambda g: g.vertices), ("people", lambda g: g.vertices.where("type in ('DOC', 'IDENTIDADE')")), ("edges", lambda g: g.edges)):
        one = of(before).agg(F.count(F.lit(1)).alias("before")).select(F.lit(name).alias("metric"), "before", F.lit(0).cast("long").alias("after"))
        two = of(after).agg(F.count(F.lit(1)).alias("after")).select(F.lit(name).alias("metric"), F.lit(0).cast("long").alias("before"), "after")
        both = one.unionByName(two)
        rows = both if rows is None else rows.unionByName(both)
    return rows.groupBy("metric").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))


def prune(g: PropertyGraph, relations: Sequence[str], low: int = 2, high: int = 100) -> PropertyGraph:
    """Link edges whose target is a store, a person, or an attribute with ``low`` to ``high`` links."""
    e = g.edges.where(F.col("relation").isin(*relations))
    entity = g.vertices.where("type in ('LOJA', 'IDENTIDADE', 'DOC')").select(F.col("id").alias("dst"))
    shared = e.groupBy("dst").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(low, high)).select("dst")
    return PropertyGraph(g.vertices, e.join(entity.union(shared).distinct(), "dst", "left_semi").select(*g.edges.columns))


def count_by(df: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count(F.lit(1)).alias("rows"))
