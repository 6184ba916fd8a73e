"""Captures of one address merged into one item, and the reports over the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions.urls import canonical_url, content_id, section_of, valid_http_url

WINDOW_S = 30 * 86400


def merge_captures(captures: DataFrame) -> DataFrame:
    """captures: url, fetched, seq, channel, title, published, modified -> an item per canonical url.

    Each field is the first non-null by (fetched, seq, url); modified the latest; channels sorted and joined by '+'. The
    date is the first feed date, else the latest modification, with its origin. One shuffle on the address, combined
    before it: every aggregate is a min or max of a small struct.
    """
    order = F.struct("fetched", "seq", "url")
    keyed = captures.withColumn("canon", canonical_url(F.col("url"))).withColumn("order", order)

    def first(c: str):
        return F.min(F.when(F.col(c).isNotNull(), F.struct("order", c)))[c]

    valid = F.min(F.when(valid_http_url(F.col("url")), F.struct("order", "url")))["url"]
    merged = keyed.groupBy("canon").agg(
        F.coalesce(valid, first("url")).alias("url"), first("title").alias("title"), first("published").alias("feed_at"), F.max("modified").alias("modified"),
        F.min("fetched").alias("first_seen"), F.max("fetched").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channels"), F.count("*").alias("captures"),
    )
    return with_identity(merged)


def with_identity(merged: DataFrame) -> DataFrame:
    """merged: canon, url, title, feed_at, modified, first_seen, last_seen, channels, captures -> items with id, moment and its origin."""
    origin = F.when(F.col("feed_at").isNotNull(), "feed").when(F.col("modified").isNotNull(), "lastmod")
    return merged.select(content_id("N-", F.col("canon")).alias("id"), "canon", "url", "title", F.coalesce("feed_at", "modified").alias("moment"), origin.alias("origin"), "modified", "first_seen", "last_seen", "channels", "captures")


def with_exclusion(items: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """items with reason: the first rule of address, title, date and window that fails. The cutoff is the latest capture."""
    cutoff = items.agg(F.max("last_seen").alias("cutoff"))
    with_cutoff = items.crossJoin(F.broadcast(cutoff))  # one row
    reason = F.when(~valid_http_url(F.col("url")), "url").when(F.col("title").isNull(), "title").when(F.col("moment").isNull(), "date").when((F.col("moment") > F.col("cutoff")) | (F.col("moment") < F.col("cutoff") - window_s), "window")
    return with_cutoff.withColumn("reason", reason).drop("cutoff")


def quality_counts(items: DataFrame) -> DataFrame:
    """measure, value, n: read, kept, excluded by reason, kept by date origin."""
    marked = with_exclusion(items)
    one = F.lit(1).cast("long")
    kinds = ((F.lit("read"), F.lit("all"), F.col("captures")), (F.lit("unique"), F.lit("all"), one), (F.when(F.col("reason").isNull(), "kept").otherwise("excluded"), F.coalesce("reason", "origin"), one))
    rows = F.array(*[F.struct(m.alias("measure"), v.alias("value"), n.alias("n")) for m, v, n in kinds])
    return marked.select(F.inline(rows)).groupBy("measure", "value").agg(F.sum("n").alias("n"))


def series_quality(series: DataFrame) -> DataFrame:
    """series: series, period, value -> kind, name, rows, first, last, missing (periods without a value), listed (these periods, by commas)."""
    lost = F.array_join(F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("period")))), ",")
    return series.groupBy(F.lit("series").alias("kind"), F.col("series").alias("name")).agg(F.count("*").alias("rows"), F.min("period").alias("first"), F.max("period").alias("last"), F.count_if(F.col("value").isNull()).alias("missing"), lost.alias("listed"))


def event_quality(events: DataFrame, least: float, since: int) -> DataFrame:
    """events: event, magnitude, moment -> the same columns by what becomes of them: kept, or excluded by magnitude or window; listed: least and greatest magnitude."""
    name = F.when(F.col("magnitude") < least, "magnitude").when(F.col("moment") < since, "window").otherwise("kept")
    shown = F.format_string("%.1f", "magnitude")
    return events.groupBy(F.lit("events").alias("kind"), name.alias("name")).agg(F.count("*").alias("rows"), F.min("moment").cast("string").alias("first"), F.max("moment").cast("string").alias("last"), F.count_if(F.col("magnitude").isNull()).alias("missing"), F.concat_ws("-", F.min(shown), F.max(shown)).alias("listed"))


def source_days(items: DataFrame, outlets: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """outlet, n, first, last, days, missing: coverage by day number for every outlet, those without items too. items: outlet, day."""
    seen = items.where(F.col("day").between(first_day, last_day)).groupBy("outlet").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), F.collect_set("day").alias("seen"))
    days = F.sequence(F.lit(first_day), F.lit(last_day))
    full = outlets.join(seen, "outlet", "left")
    missing = F.array_join(F.transform(F.array_sort(F.array_except(days, F.coalesce("seen", F.array().cast("array<int>")))), lambda d: d.cast("string")), ",")
    return full.select("outlet", F.coalesce("n", F.lit(0)).alias("n"), "first", "last", F.coalesce(F.size("seen"), F.lit(0)).alias("days"), missing.alias("missing")).withColumn("days", F.greatest("days", F.lit(0)))
