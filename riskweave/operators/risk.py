"""Splits, metrics, models, bands and the queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.operators.relational import rank_rows


def group_bucket(group: Column, seed: int, of: int = 100) -> Column:
    """A bucket that all rows of a group share, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), group.cast("string"))), 1, 8), 16, 10).cast("long") % of


def split_scores(df: DataFrame, group: str, label: str, seeds: Sequence[int], test: int = 30) -> DataFrame:
    """seed, gap: how far each seed's test share of positives lies from the whole's; one aggregate for all seeds."""
    tests = F.array(*[F.struct(F.lit(s).alias("seed"), (group_bucket(F.col(group), s) < test).alias("in_test")) for s in seeds])
    x = df.select(F.col(label).cast("double").alias("y"), F.explode(tests).alias("s")).select("y", "s.*")
    part = F.avg(F.when(F.col("in_test"), F.col("y")))
    return x.groupBy("seed").agg(F.abs(part - F.avg("y")).alias("gap"))


def group_split(df: DataFrame, group: str, label: str, seeds: Sequence[int] = range(20), test: int = 30) -> DataFrame:
    """Adds ``in_test``: the seed of least gap, ties by seed. Groups are never divided."""
    best = split_scores(df, group, label, list(seeds), test).orderBy(F.col("gap").asc_nulls_last(), "seed").first()  # one row of at most len(seeds)
    return df.withColumn("in_test", group_bucket(F.col(group), best["seed"] if best else 0) < test)


def ranking_metrics(df: DataFrame, score: str, label: str, ident: str, k: int = 100) -> DataFrame:
    """One row: roc_auc (ties by mid-ranks), average_precision, precision_at_k, recall_at_k.

    Rows are first counted per score, so the running sums are over distinct
    scores; precision at k breaks ties by the identifier.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    down = W.orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    c = per.withColumn("cp", F.sum("p").over(down)).withColumn("cn", F.sum("n").over(down))
    tot = df.agg(F.sum(F.col(label).cast("double")).alias("tp"), F.count(F.lit(1)).cast("double").alias("tn"))
    c = c.join(F.broadcast(tot))
    neg = F.col("n") - F.col("p")
    pos_above = F.col("cp") - F.col("p")
    curve = c.agg(
        (F.sum(neg * (pos_above + F.col("p") / 2)) / F.max(F.col("tp") * (F.col("tn") - F.col("tp")))).alias("roc_auc"),
        (F.sum(F.col("p") * F.col("cp") / F.col("cn")) / F.max("tp")).alias("average_precision"),
    )
    top = df.orderBy(F.desc(score), ident).limit(k).agg(F.avg(F.col(label).cast("double")).alias("precision_at_k"), F.sum(F.col(label).cast("double")).alias("_hit"))
    return curve.join(F.broadcast(top)).join(F.broadcast(tot)).select("roc_auc", "average_precision", "precision_at_k", (F.col("_hit") / F.greatest("tp", F.lit(1.0))).alias("recall_at_k"))


def capture_curve(df: DataFrame, score: str, label: str, ident: str) -> DataFrame:
    """position, share: positives found among the first rows in score order."""
    r = rank_rows(df.select(ident, score, F.col(label).cast("double").alias("_y")), [F.desc(score), F.col(ident)], "position")
    hits = r.where("_y > 0").select("position", "_y")
    total = hits.agg(F.sum("_y").alias("_t"))
    # only positives move the curve: their running count is over the positives alone
    run = hits.withColumn("found", F.sum("_y").over(W.orderBy("position")))
    return run.join(F.broadcast(total)).select("position", (F.col("found") / F.col("_t")).alias("share"))


def precision_recall_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, precision, recall per distinct score."""
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    w = W.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    tot = df.agg(F.sum(F.col(label).cast("double")).alias("tp"))
    return per.join(F.broadcast(tot)).select("threshold", (F.sum("p").over(w) / F.sum("n").over(w)).alias("precision"), (F.sum("p").over(w) / F.col("tp")).alias("recall"))


def confusion_at(df: DataFrame, score: str, label: str, quantile: float = 0.95) -> DataFrame:
    """actual, predicted, rows at the exact quantile of the score."""
    cut = df.agg(F.percentile(score, F.lit(quantile)).alias("_cut"))
    return df.join(F.broadcast(cut)).groupBy(F.col(label).cast("int").alias("actual"), (F.col(score) >= F.col("_cut")).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("rows"))


def with_band(df: DataFrame, score: str, high: float = 0.95, middle: float = 0.85) -> DataFrame:
    """Adds ``band``: ALTO from the high quantile on, MEDIO from the middle one, else BAIXO."""
    cut = df.agg(F.percentile(score, F.array(F.lit(high), F.lit(middle))).alias("_q"))
    return df.join(F.broadcast(cut)).withColumn("band", F.when(F.col(score) >= F.get("_q", 0), "ALTO").when(F.col(score) >= F.get("_q", 1), "MEDIO").otherwise("BAIXO")).drop("_q")


def queue(df: DataFrame, score: str, label: str, ident: str, as_of: Column) -> DataFrame:
    """Adds position (score descending, then identifier), new_suspect (unlabelled and ALTO) and scored_at."""
    return rank_rows(with_band(df, score), [F.desc(score), F.col(ident)], "position").withColumn("new_suspect", ((F.col(label) == 0) & (F.col("band") == "ALTO")).cast("int")).withColumn("scored_at", as_of)


def band_by_label(q: DataFrame, label: str) -> DataFrame:
    return q.groupBy("band", label).agg(F.count(F.lit(1)).alias("rows"))


def boosted_trees(features: Sequence[str], label: str, rounds: int = 300, depth: int = 4, step: float = 0.05, subsample: float = 0.8, seed: int = 42) -> Pipeline:
    """Assembler and boosted trees; the rows carry ``_weight`` (see ``weighted``)."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_weight", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed)])


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Adds ``_weight``: negatives per positive for positives, 1 for negatives."""
    c = df.agg(F.sum((F.col(label) == 0).cast("double")).alias("_n"), F.sum((F.col(label) == 1).cast("double")).alias("_p"))
    return df.join(F.broadcast(c)).withColumn("_weight", F.when(F.col(label) == 1, F.col("_n") / F.greatest("_p", F.lit(1.0))).otherwise(1.0)).drop("_n", "_p")


def score_with(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    got = model.transform(df)
    return got.withColumn(out, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, group: str, folds: int = 5, **params) -> DataFrame:
    """Each row scored by a model that saw no row of its group's fold."""
    x = weighted(df, label).withColumn("_fold", group_bucket(F.col(group), 7, folds))
    out = None
    for k in range(folds):
        model = boosted_trees(features, label, **params).fit(x.where(F.col("_fold") != k))
        part = score_with(model, x.where(F.col("_fold") == k))
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold", "_weight")


def importance(model: PipelineModel, features: Sequence[str], k: int = 15) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]


def top_contributors(model: PipelineModel, df: DataFrame, features: Sequence[str], medians: dict[str, float], ident: str, k: int = 3) -> DataFrame:
    """identifier, signals: the k features whose replacement by the unflagged median lowers the score most, joined by ", ".

    A stated proxy of per-row contributions: one scoring pass over the rows,
    each carried once per feature.
    """
    base = score_with(model, df).select(ident, F.col("score").alias("_s"))
    values = F.explode(F.array(*[F.lit(f) for f in features])).alias("_f")
    x = df.select(ident, *features, values)
    x = x.select(ident, "_f", *[F.when(F.col("_f") == f, F.lit(float(medians[f]))).otherwise(F.col(f).cast("double")).alias(f) for f in features])
    drop = score_with(model, x).select(ident, "_f", F.col("score").alias("_w")).join(base, ident).select(ident, "_f", (F.col("_s") - F.col("_w")).alias("_d"))
    ranked = drop.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct((-F.col("_d")).alias("d"), F.col("_f").alias("f")))).alias("_a"))
    return ranked.select(ident, F.array_join(F.transform(F.slice("_a", 1, k), lambda s: s["f"]), ", ").alias("signals"))


def what_if(df: DataFrame, graph_features: Sequence[str], far: float = 99.0) -> DataFrame:
    """The rows without their links: graph features 0, distance ``far``."""
    return df.withColumns({c: F.lit(far if c == "distance" else 0.0) for c in graph_features if c in df.columns})
