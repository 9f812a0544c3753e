"""Iterative graph algorithms as frames: rank, components, labels, triangles, distances, messages.

Every loop writes its state to the shared folder every few rounds in place of a
long lineage, so lost executors repeat one round. No vertex gathers its
neighbours in one row; all rounds are joins and partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.runtime import Cuts


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = 10, reset: float = 0.15, cut_every: int = 4) -> DataFrame:
    """id, rank: static PageRank from 1.0 each, edges counted by row, ranks scaled to sum to the number of vertices.

    Edges with an end outside the vertices are left out; a vertex without
    outgoing edges passes nothing on.
    """
    cuts = Cuts(edges.sparkSession, "pagerank")
    v = vertices.select("id").distinct()
    e = edges.select("src", "dst").join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = e.groupBy("src").agg(F.sum("n").alias("out"))
    e = cuts.put(e.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")))
    v = cuts.put(v)
    r = v.withColumn("rank", F.lit(1.0))
    for i in range(rounds):
        got = e.join(r.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("m"))
        r = v.join(got.withColumnRenamed("dst", "id"), "id", "left").select("id", (F.lit(reset) + (1 - reset) * F.coalesce("m", F.lit(0.0))).alias("rank"))
        if (i + 1) % cut_every == 0:
            r = cuts.put(r)
    r = cuts.put(r)
    total = r.agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("c")).first()  # one row
    return r.select("id", (F.col("rank") * (total["c"] or 0) / (total["s"] or 1.0)).alias("rank"))


def personalized_pagerank(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = 10, reset: float = 0.15, cut_every: int = 4) -> DataFrame:
    """id, rank: personalised ranks of all seeds summed.

    Each seed starts with 1 and takes back ``reset`` of its mass per round. The
    update is linear in the start, so the sum over seeds is one rank with the
    seeds' joint restart: the work does not grow with their number.
    """
    cuts = Cuts(edges.sparkSession, "ppr")
    v = vertices.select("id").distinct()
    e = edges.select("src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = e.groupBy("src").agg(F.sum("n").alias("out"))
    e = cuts.put(e.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")))
    s = seeds.select("id").distinct().withColumn("start", F.lit(1.0))
    v = cuts.put(v.join(s, "id", "left").fillna(0.0, ["start"]))
    r = v.select("id", F.col("start").alias("rank"))
    for i in range(rounds):
        got = e.join(r.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("m"))
        r = v.join(got.withColumnRenamed("dst", "id"), "id", "left").select("id", (reset * F.col("start") + (1 - reset) * F.coalesce("m", F.lit(0.0))).alias("rank"))
        if (i + 1) % cut_every == 0:
            r = cuts.put(r)
    return r


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: undirected components, each named by its least vertex; isolated vertices are their own.

    Alternating large-star and small-star contraction until the edges no longer
    change. Neighbours are only ever reduced to their least one, so a hub is a
    partial aggregate and a join, never a list.
    """
    cuts = Cuts(edges.sparkSession, "components")
    e = cuts.put(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    while True:
        # large star: every greater neighbour of u goes to the least of u and its neighbours
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cuts.put(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(least, "u")
        nxt = cuts.put(j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        cuts.drop(e, large)
        e = nxt
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return vertices.select("id").distinct().join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, label: the most frequent label among neighbours in both directions; of equals the least."""
    cuts = Cuts(edges.sparkSession, "labels")
    e = cuts.put(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    lab = vertices.select("id", F.col("id").alias("label")).distinct()
    for _ in range(rounds):
        votes = e.join(lab.withColumnRenamed("id", "src"), "src").groupBy("dst", "label").agg(F.sum("n").alias("n"))
        best = votes.groupBy("dst").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("_b")).select(F.col("dst").alias("id"), F.col("_b.label").alias("_l"))
        lab = cuts.put(lab.join(best, "id", "left").select("id", F.coalesce("_l", "label").alias("label")))
    return lab


def triangle_count(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, triangles through each vertex, undirected and without repeats; 0 where there is none.

    Edges point from the lower degree to the higher, so a hub starts few wedges.
    """
    cuts = Cuts(edges.sparkSession, "triangles")
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = e.select(F.col("a").alias("id")).unionAll(e.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    e = e.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    e = cuts.put(e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t")))
    wedge = e.join(e.withColumnRenamed("t", "w"), "s").where("t < w").select("s", F.col("t").alias("x"), F.col("w").alias("y"))
    close = e.select(F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"))
    tri = wedge.join(close, ["x", "y"])
    hits = tri.select(F.explode(F.array("s", "x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return vertices.select("id").distinct().join(hits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


def nearest_other(vertices: DataFrame, edges: DataFrame, landmarks: DataFrame, none: int = 99) -> DataFrame:
    """id, distance: hops to the nearest landmark other than the vertex itself, over edges in both directions.

    Each vertex keeps its two nearest landmarks: it can exclude only itself, so
    two suffice, however many there are. Ends when no vertex changes.
    """
    cuts = Cuts(edges.sparkSession, "nearest")
    e = cuts.put(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    front = cuts.put(landmarks.select("id", F.col("id").alias("mark"), F.lit(0).alias("d")).distinct())
    reached, hop = [front], 0
    while not front.isEmpty():
        hop += 1
        state = cuts.together(reached)
        sent = e.join(front.select(F.col("id").alias("src"), "mark"), "src").select(F.col("dst").alias("id"), "mark").distinct()
        fresh = sent.join(state, ["id", "mark"], "left_anti")
        have = state.groupBy("id").agg(F.count(F.lit(1)).alias("_c"))
        # of a round's newcomers the least marks fill the free places: minimum twice, no list
        one = fresh.groupBy("id").agg(F.min("mark").alias("mark"))
        two = fresh.join(one, ["id", "mark"], "left_anti").groupBy("id").agg(F.min("mark").alias("mark"))
        a = one.join(have, "id", "left").where(F.coalesce("_c", F.lit(0)) < 2).select("id", "mark")
        b = two.join(have, "id", "left").where(F.coalesce("_c", F.lit(0)) < 1).select("id", "mark")
        front = cuts.put(a.unionByName(b).withColumn("d", F.lit(hop)))
        reached.append(front)
    state = cuts.together(reached)
    best = state.where("mark <> id").groupBy("id").agg(F.min("d").alias("d"))
    return vertices.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("d", F.lit(none)).alias("distance"))


def aggregate_messages(vertices: DataFrame, edges: DataFrame, to_dst: dict[str, Column], columns: list[str]) -> DataFrame:
    """id and aggregates over the messages that edges carry from source to target.

    ``to_dst`` maps a name to an aggregate over the source's columns, given as
    ``src_<column>``. Vertices that receive nothing are absent.
    """
    s = vertices.select(F.col("id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in columns])
    return edges.select("src", "dst").join(s, "src").groupBy(F.col("dst").alias("id")).agg(*[c.alias(n) for n, c in to_dst.items()])
