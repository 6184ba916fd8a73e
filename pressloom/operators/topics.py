"""Topics: keywords, nearest centroid, a linear model, routing by margin and cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions.text import fold
from pressloom.operators.ranks import places

MARGIN = 0.35


def keyword_topics(rows: DataFrame, keywords: dict[str, Sequence[str]], none: str) -> DataFrame:
    """rows: id, text -> id, topic, confidence: most keyword hits (ties in the order given); min(hits / 3, 1); none without a hit."""
    text = fold(F.col("text"))
    hits = [F.struct(sum((F.regexp_count(text, F.lit(k)) for k in words), F.lit(0)).alias("hits"), F.lit(-i).alias("late"), F.lit(topic).alias("topic")) for i, (topic, words) in enumerate(keywords.items())]
    best = rows.select("id", F.array_max(F.array(*hits)).alias("best"))
    return best.select("id", F.when(F.col("best.hits") > 0, F.col("best.topic")).otherwise(none).alias("topic"), F.round(F.least(F.col("best.hits") / 3, F.lit(1.0)), 6).alias("confidence"))


def nearest_centroid(train: DataFrame, rows: DataFrame) -> DataFrame:
    """train: label, v; rows: id, v (unit vectors) -> id, label, score: most cosine to a class mean (one row a class)."""
    parts = train.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    norms = parts.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    weights = parts.join(norms, "label").select("label", "k", (F.col("x") / F.col("norm")).alias("w"))
    scores = rows.select("id", F.posexplode("v").alias("k", "x")).join(weights, "k").groupBy("id", "label").agg(F.round(F.sum(F.col("x") * F.col("w")), 6).alias("score"))
    best = scores.groupBy("id").agg(F.max(F.struct("score", (-F.col("label")).alias("late"))).alias("b"))
    return best.select("id", (-F.col("b.late")).alias("label"), F.col("b.score").alias("score"))


def classified(found: dict[str, DataFrame]) -> DataFrame:
    """method -> rows (id, topic, confidence), preferred methods first -> id, topic, confidence, method: of each id, what the first method that has it says."""
    order = F.create_map(*[x for k, name in enumerate(found) for x in (F.lit(k), F.lit(name))])
    rows = reduce(DataFrame.unionByName, [rows.select("id", F.lit(k).alias("k"), "topic", F.col("confidence").cast("double")) for k, rows in enumerate(found.values())])
    best = rows.groupBy("id").agg(F.min(F.struct("k", "topic", "confidence")).alias("b"))
    return best.select("id", "b.topic", "b.confidence", F.element_at(order, F.col("b.k")).alias("method"))


def folds(rows: DataFrame, k: int = 5, seed: int = 7) -> DataFrame:
    """rows: id, label -> fold: stratified, by hash order within a class, however large the class."""
    placed = places(rows, ["label"], [F.asc(F.xxhash64("id", F.lit(seed))), F.asc("id")])
    return placed.select(*rows.columns, ((F.col("place") - 1) % k).cast("int").alias("fold"))


def linear_model(train: DataFrame, c: float = 4.0, max_iter: int = 2000):
    """Multinomial logistic regression with balanced class weights. train: label (0..), v. Weights sum to the rows, so regParam is 1 / (c * rows)."""
    counts = train.groupBy("label").agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("all"), F.count("*").alias("classes")).first()
    weighed = train.join(counts, "label").withColumn("weight", F.lit(float(totals["all"])) / (totals["classes"] * F.col("n")))
    ready = weighed.select(F.col("label").cast("double").alias("label"), "weight", array_to_vector("v").alias("features"))
    return LogisticRegression(family="multinomial", weightCol="weight", regParam=1 / (c * totals["all"]), elasticNetParam=0.0, standardization=False, maxIter=max_iter).fit(ready)


def predict(model, rows: DataFrame) -> DataFrame:
    """id, label, confidence, margin of the first two probabilities."""
    scored = model.transform(rows.withColumn("features", array_to_vector("v")))
    p = F.sort_array(vector_to_array("probability"), asc=False)
    return scored.select("id", F.col("prediction").cast("int").alias("label"), F.round(p[0], 6).alias("confidence"), F.round(p[0] - p[1], 6).alias("margin"))


def routed(predictions: DataFrame, verdicts: DataFrame, margin: float = MARGIN) -> DataFrame:
    """predictions: id, label, margin; verdicts: id, verdict -> id, label, method: the verdict where the margin is small and there is one."""
    both = predictions.join(verdicts, "id", "left")
    use = (F.col("margin") < margin) & F.col("verdict").isNotNull()
    return both.select("id", F.when(use, F.col("verdict")).otherwise(F.col("label")).alias("label"), F.when(use, "llm").otherwise("embeddings").alias("method"))


def cross_validated(rows: DataFrame, k: int = 5) -> DataFrame:
    """rows: id, label, v -> id, label (truth), predicted: every row by a model that never saw it. The loop is over folds, not data."""
    dealt, out = folds(rows, k), None
    for i in range(k):
        test = dealt.where(F.col("fold") == i)
        found = predict(linear_model(dealt.where(F.col("fold") != i)), test).select("id", F.col("label").alias("predicted"))
        part = test.select("id", "label").join(found, "id")
        out = part if out is None else out.unionByName(part)
    return out
