"""Feature engineering and clustering with Spark ML.

Every estimator is fit on the train split and applied frozen to both splits (M12), as
``Pipeline.fit(train).transform(test)``.  Vectors are turned back into arrays with
``vector_to_array`` so that later steps stay plain SQL expressions.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.codes import arg_max
from tessera.operators import topics

TASK_ROWS = 1 << 19


def string_index(train: DataFrame, cols: list[str], suffix: str = "_idx", weight: str | None = None):
    """M1: multi-column StringIndexer, frequency order, unseen and null -> extra index.
    ``weight``: column with the number of rows that a row stands for."""
    outs = [c + suffix for c in cols]
    if weight is None:
        return StringIndexer(inputCols=cols, outputCols=outs, handleInvalid="keep",
                             stringOrderType="frequencyDesc").fit(train)
    labels = []
    for c in cols:  # the labels are on the driver in a fitted indexer; ties by label as Java compares
        rows = train.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string")).agg(F.sum(weight)).collect()
        labels.append([x for x, _ in sorted(rows, key=lambda r: (-r[1], r[0].encode("utf-16-be")))])
    return StringIndexerModel.from_arrays_of_labels(labels, cols, outs, "keep")


def bag_of_words(df: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """M2: bags over all terms for the topic model, as blocks of documents (see ``topics``):
    no vocabulary on the driver."""
    return topics.bags(df, keys, tokens)


def term_counts(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """M2 as a table (id, term, count): every term, no vocabulary on the driver."""
    return (df.select(id_col, F.explode(tokens).alias("term")).groupBy(id_col, "term")
            .agg(F.count(F.lit(1)).cast("double").alias("count")))


def topic_model(train: DataFrame, k: int, max_iter: int, seed: int = 1) -> topics.TopicModel:
    """M3: LDA by the online optimizer on bags, with an explicit seed; topics are a table."""
    return topics.fit(train, k, max_iter, seed)


def dominant_topic(df: DataFrame, dist_col: str = "topicDistribution",
                   out: str = "skills") -> DataFrame:
    """Index of the largest topic weight (ties -> lowest index)."""
    return df.withColumn(out, arg_max(F.col(dist_col)))


def assemble(cols: list[str], out: str = "features") -> VectorAssembler:
    """M5: feature vector in a fixed column order (nulls must be filled first)."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error")


def scaler(inp: str = "features", out: str = "scaled") -> StandardScaler:
    """M6: unit sample standard deviation, no centring (zero variance -> 0)."""
    return StandardScaler(inputCol=inp, outputCol=out, withStd=True, withMean=False)


def kmeans(k: int, seed: int = 1, features: str = "scaled", max_iter: int = 20) -> KMeans:
    """M7: KMeans on the scaled features."""
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="prediction",
                  maxIter=max_iter)


def bounded_tasks(df: DataFrame, rows: int | None = None, weight: str | None = None) -> DataFrame:
    """``df`` in partitions of about ``rows`` rows at most.  Adaptive execution joins partitions
    by their compressed bytes in a shuffle; fits keep rows as objects, which are far larger.
    With ``weight`` the rows that rows stand for are counted."""
    n = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    parts = -(-n // (rows or TASK_ROWS))
    return df.repartition(parts) if parts > 1 else df


def _fit_weighted(stages, train: DataFrame, weight: str) -> PipelineModel:
    """``Pipeline.fit`` where a row stands for ``weight`` rows: an estimator without weights sees
    it so many times."""
    fitted = []
    for stage in stages:
        if isinstance(stage, Estimator):
            if stage.hasParam("weightCol"):
                stage = stage.copy({stage.getParam("weightCol"): weight}).fit(train)
            else:
                stage = stage.fit(train.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col(weight)))))
        fitted.append(stage)
        train = stage.transform(train)
    return PipelineModel(fitted)


def fit_apply(stages, train: DataFrame, *others: DataFrame, weight: str | None = None):
    """Fit every stage on ``train`` and apply the frozen model to each frame.  ``weight``:
    column with the number of rows that a row of ``train`` stands for."""
    train = bounded_tasks(train, weight=weight)
    model = Pipeline(stages=list(stages)).fit(train) if weight is None else _fit_weighted(stages, train, weight)
    return model, [model.transform(train)] + [model.transform(o) for o in others]


def silhouette(df: DataFrame, features: str, prediction: str, weight: str | None = None) -> float:
    """M9: silhouette with squared Euclidean distance (Spark's evaluator; the caller
    picks the features column, see D5).  Rows that stand for ``weight`` rows go through
    ``silhouette_table``: the evaluator takes a weight for one heavier point."""
    if weight is not None:
        points = df.select(vector_to_array(features).alias("v"), prediction, weight)
        return silhouette_table(points, "v", prediction, weight).first()[0]
    ev = ClusteringEvaluator(featuresCol=features, predictionCol=prediction,
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    return ev.evaluate(df)


def centres_table(spark, model, id_col: str = "cluster") -> DataFrame:
    """Cluster centres as a table (cluster, center array<double>); bounded by k."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, f"{id_col} int, center array<double>")


def nearest_centre(points: DataFrame, vec: str, centres: DataFrame, id_col: str = "cluster",
                   center: str = "center", out: str = "prediction") -> DataFrame:
    """M8: assign each point to the nearest centre of a small centre table (squared
    Euclidean, ties -> lowest id).  The centres are folded into one array by a scalar
    subquery, so each point is compared in place — no join.  The centre
    table has one row per cluster (the k of the fitted model)."""
    arr = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"),
                                                           F.col(center).alias("c"))))).scalar()
    # the subquery is projected into a column first (it cannot sit inside a lambda)
    d = F.transform("_centres", lambda c: F.struct(
        F.aggregate(F.zip_with(F.col(vec), c["c"], lambda a, b: (a - b) * (a - b)),
                    F.lit(0.0), lambda s, t: s + t).alias("d"), c["id"].alias("id")))
    return (points.withColumn("_centres", arr).withColumn(out, F.array_min(d)["id"])
            .drop("_centres"))


def to_columns(df: DataFrame, vec: str, names: list[str], cast: str = "float") -> DataFrame:
    """Scaled vector -> one named column per feature."""
    arr = vector_to_array(F.col(vec))
    return df.select("*", *[arr[i].cast(cast).alias(n) for i, n in enumerate(names)]).drop(vec)


def as_vector(arr_col: str, out: str) -> F.Column:
    return array_to_vector(F.col(arr_col)).alias(out)


def silhouette_table(points: DataFrame, vec: str, cluster: str, weight: str | None = None) -> DataFrame:
    """M9 as a distributed aggregate: mean silhouette (squared Euclidean) of
    ``points`` labelled by ``cluster``.  Per cluster only (n, Σy, Σ|y|²) is needed — k
    rows, folded into one array by a scalar subquery — so every point is scored in
    place: a = Σ distances to its own cluster / (n-1), b = smallest mean distance to
    another cluster, s = (b-a)/max(a,b), 0 for a one-point cluster.  ``weight``: column
    with the number of points that a row stands for."""
    w = F.lit(1) if weight is None else F.col(weight)
    points = points.withColumn("_w", w)
    dims = points.select(F.posexplode(vec).alias("d", "x"), cluster, "_w").withColumn("x", F.col("x") * F.col("_w"))
    sums = (dims.groupBy(cluster, "d").agg(F.sum("x").alias("s"))
            .groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("_s"))
            .select(cluster, F.transform("_s", lambda t: t["s"]).alias("ysum")))
    norms = (points.groupBy(cluster)
             .agg(F.sum("_w").alias("n"),
                  F.sum(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x) * F.col("_w")).alias("ysq")))
    stats = norms.join(sums, cluster)
    arr = stats.agg(F.collect_list(F.struct(F.col(cluster).alias("id"), "n", "ysq", "ysum"))).scalar()
    xsq = F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + x * x)

    def mean_dist(c):
        dot = F.aggregate(F.zip_with(F.col(vec), c["ysum"], lambda a, b: a * b), F.lit(0.0),
                          lambda s, t: s + t)
        return (xsq * c["n"] + c["ysq"] - F.lit(2.0) * dot) / c["n"]

    per = points.select(F.col(cluster).alias("_own"), F.col(vec), xsq.alias("_xsq"), "_w",
                        arr.alias("_stats"))
    per = per.withColumn("_d", F.transform("_stats", lambda c: F.struct(
        c["id"].alias("id"), c["n"].alias("n"), mean_dist(c).alias("m"))))
    own = F.filter("_d", lambda c: c["id"] == F.col("_own"))[0]
    others = F.filter("_d", lambda c: c["id"] != F.col("_own"))
    a = own["m"] * own["n"] / (own["n"] - F.lit(1.0))
    b = F.array_min(F.transform(others, lambda c: c["m"]))
    s = (F.when(own["n"] <= 1, F.lit(0.0))
         .when(a < b, F.lit(1.0) - a / b)
         .when(a > b, b / a - F.lit(1.0)).otherwise(F.lit(0.0)))
    return per.agg((F.sum(s * F.col("_w")) / F.sum(F.when(s.isNotNull(), F.col("_w")))).alias("silhouette"))
