"""Measures over predictions, rankings, calls and answers. An empty denominator is NULL, but for precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.operators.ranks import at_places, places


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def ndcg_gain(grade: Column, rank: Column) -> Column:
    """Gain of a grade at a rank (from 1)."""
    return (F.pow(F.lit(2.0), grade) - 1) / (F.ln(rank + F.lit(1.0)) / F.ln(F.lit(2.0)))


def binary_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """rows: truth, predicted (nullable: missing, which counts against recall) -> tp, fp, fn, tn, missing, precision, recall, f1."""
    p, t = F.coalesce(F.col("predicted"), F.lit(False)), F.col("truth")
    counts = rows.groupBy(*keys).agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("tp", p & t), ("fp", p & ~t), ("fn", ~p & t), ("tn", ~p & ~t), ("missing", F.col("predicted").isNull()))])
    precision, recall = (F.coalesce(share(F.col("tp"), F.col("tp") + F.col(o)), F.lit(0.0)) for o in ("fp", "fn"))
    both = counts.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.coalesce(F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))), F.lit(0.0))
    return both.select(*keys, "tp", "fp", "fn", "tn", "missing", *[F.round(c, 6).alias(n) for c, n in ((F.col("precision"), "precision"), (F.col("recall"), "recall"), (f1, "f1"))])


def class_report(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows: truth, predicted; classes: label -> label, support, precision, recall, f1 for every class, absent ones too."""
    flat = rows.select(F.inline(F.array(*[F.struct(F.col(c).alias("label"), (F.col("truth") == F.col("predicted")).alias("ok"), F.lit(side).alias("side")) for side, c in ((0, "truth"), (1, "predicted"))])))
    sums = flat.groupBy("label").agg(F.count_if((F.col("side") == 0) & F.col("ok")).alias("tp"), F.count_if(F.col("side") == 0).alias("support"), F.count_if(F.col("side") == 1).alias("said"))
    full = classes.join(sums, "label", "left").na.fill(0, ["tp", "support", "said"])
    p, r = F.coalesce(share(F.col("tp"), F.col("said")), F.lit(0.0)), F.coalesce(share(F.col("tp"), F.col("support")), F.lit(0.0))
    return full.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(share(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def nearest_rank(rows: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """Element number ceil(q * n) in order, and the median, by key."""
    placed = places(rows.where(F.col(value).isNotNull()).select(*keys, value), keys, [F.asc(value)])
    n = F.col("total")
    found = at_places(placed, keys, value, low=F.floor((n + 1) / 2), up=F.floor(n / 2) + 1, high=F.greatest(F.ceil(F.lit(q) * n), F.lit(1)))
    return found.select(*keys, n.alias("n"), ((F.col("low") + F.col("up")) / 2).alias("median"), "high")


def ratio(rows: DataFrame, *keys: str) -> DataFrame:
    """rows: id, passed -> passed, total, value."""
    return rows.groupBy(*keys).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.round(share(F.count_if("passed"), F.count("*")), 6).alias("value"))


def failing(rows: DataFrame, *keys: str) -> DataFrame:
    """rows: id, passed -> keys, id of those that failed: a row each, however many."""
    return rows.where(~F.coalesce("passed", F.lit(False))).select(*keys, "id")


def usage(calls: DataFrame) -> DataFrame:
    """calls: model, status, cache, latency, tokens -> per model calls (misses), hits, errors, tokens, p50 and p95 of good misses (linear)."""
    miss, good = F.col("cache") == "miss", (F.col("cache") == "miss") & (F.col("status") == "ok")
    p = [F.round(F.coalesce(F.percentile(F.when(good, F.col("latency")), q), F.lit(0.0)), 4).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))]
    return calls.groupBy("model").agg(F.count_if(miss).alias("calls"), F.count_if(~miss).alias("hits"), F.count_if(miss & (F.col("status") == "error")).alias("errors"), F.sum("tokens").alias("tokens"), *p)


def spent(calls: DataFrame, since_us: int) -> DataFrame:
    """Units of misses since a time: 1 for an error, else its tokens and 1 at least."""
    unit = F.when(F.col("status") == "error", 1).otherwise(F.greatest(F.col("tokens"), F.lit(1)))
    return calls.where((F.col("cache") == "miss") & (F.col("us") >= since_us)).groupBy("model").agg(F.sum(unit).alias("units"))


def feed_coverage(records: DataFrame) -> DataFrame:
    """records: url, status, complete, error (nullable) -> measure, value, n: attempts, distinct queries that were ever complete, errors by status."""
    whole = records.agg(F.count("*").alias("attempts"), F.countDistinct(F.when(F.col("complete"), F.col("url"))).alias("complete"))
    both = whole.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit("all").alias("value"), F.col(m).alias("n")) for m in ("attempts", "complete")])).alias("x")).select("x.*")
    errors = records.where(F.coalesce(F.col("error"), F.lit("")) != "").groupBy(F.coalesce(F.col("status").cast("string"), F.lit("none")).alias("value")).agg(F.count("*").alias("n"))
    return both.unionByName(errors.select(F.lit("errors").alias("measure"), "value", "n"))


def peaks(calls: DataFrame) -> DataFrame:
    """Most calls and most tokens of any calendar minute, misses only, by model."""
    minutes = calls.where("cache = 'miss'").groupBy("model", F.floor(F.col("us") / 60_000_000).alias("minute")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return minutes.groupBy("model").agg(F.max("calls").alias("calls"), F.max("tokens").alias("tokens"))


def rate_window(calls: DataFrame, span_us: int = 60_000_000) -> DataFrame:
    """Per call: calls and tokens of its model within the last span (exclusive of exactly the span), itself included.

    Calls of one microsecond are one row. Time is cut into cells of the span, so a call's span ends in its cell and begins
    in the one before: of its own cell it takes the sum from the begin, of the one before the sum from the end. Both only
    grow, so a cell is swept once, however many calls it holds.
    """
    good = calls.where("cache = 'miss'")
    moments = good.groupBy("model", "us").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).withColumn("own", F.floor(F.col("us") / span_us))
    us, own, start = F.col("us"), F.col("own"), F.col("us") - (span_us - 1)
    # said: what a cell holds, in order of time or against it; asked: where spans begin in the cell before
    place = lambda cell, back, pos, said: F.struct(cell.alias("cell"), F.lit(back).alias("back"), pos.alias("pos"), F.lit(said).alias("said"))
    dealt = moments.select("model", "us", "n", "t", F.explode(F.array(place(own, False, us, True), place(own, True, -us, True), place(own - 1, True, -start, False))).alias("p")).select("model", "us", "n", "t", "p.*")
    w = Window.partitionBy("model", "cell", "back").orderBy("pos", F.desc("said")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.select("model", "us", "back", "said", *(F.sum(F.when(F.col("said"), F.col(c))).over(w).alias(name) for c, name in (("n", "calls"), ("t", "tokens"))))
    sums = swept.where(F.col("said") != F.col("back")).groupBy("model", "us").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
    return good.select("id", "model", "us").join(sums, ["model", "us"]).select("id", "model", "calls", "tokens")
