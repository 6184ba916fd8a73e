"""Streams over the event table, run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.storage import shared_dir, table
from pressloom.plans import views as V
from pressloom.sources import readers
from pressloom.streaming import jobs


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


def _ended(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def live_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Closed minutes of the call stream: most calls and tokens by model."""
    out = shared_dir(spark)
    calls = _stream(spark, sf, "events").where("event_type <> 'view'").select(F.concat(F.lit("m"), F.pmod("user_id", F.lit(5))).alias("model"), F.timestamp_micros(F.expr(V.MICROS)).alias("ts"), F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)).alias("tokens"))
    _ended(jobs.minute_peaks(calls, out, shared_dir(spark)))
    return spark.read.schema("start long, model string, calls long, tokens long").parquet(out).groupBy("model").agg(F.count("*").alias("minutes"), F.max("calls").alias("calls"), F.max("tokens").alias("tokens"))


PEAKS = V.with_(V.LEDGER) + """, w as (select model, us // 60000000 as m, count(*) as c, sum(tokens) as t from ledger where cache = 'miss' group by 1, 2)
select model, count(*) as minutes, max(c) as calls, max(t)::bigint as tokens from w where (m + 1) * 60000000 <= (select max(us) from ledger where cache = 'miss') // 1000 * 1000 - 120000000 group by model"""


def live_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Moves seen on the decision stream, allowed or not."""
    out, states = shared_dir(spark), F.create_map(*[F.lit(x) for p in V.STATES.items() for x in p])
    d = _stream(spark, sf, "events").select(F.col("user_id").alias("case_id"), states[F.col("event_type")].alias("state"), F.expr(V.MICROS).alias("us"), F.col("event_id").alias("seq"))
    _ended(jobs.live_reviews(d, out, shared_dir(spark)))
    rows = spark.read.schema("case_id long, seq long, previous string, state string, allowed boolean").parquet(out)
    return rows.where("previous is not null").groupBy("previous", "state", "allowed").agg(F.count("*").alias("n"))


def _reviews_sql() -> str:
    from pressloom.operators.reviews import MOVES

    allowed = " or ".join(f"(previous = '{a}' and state in ({', '.join(repr(b) for b in bs)}))" for a, bs in MOVES.items())
    return V.with_(V.REVIEWS) + f"select previous, state, {allowed} as allowed, count(*) as n from (select *, lag(state) over (partition by case_id order by us, seq) as previous from reviews) where previous is not null group by 1, 2, 3"


def wide_series(spark: SparkSession, sf: str) -> DataFrame:
    """A wide quarterly table back in long form, first occurrence of each period."""
    o = table(spark, sf, "orders").select(F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string")).alias("quarter"), F.col("o_orderstatus").alias("s"))
    wide = o.groupBy("quarter").agg(*[F.format_string("%d,5", F.count_if(F.col("s") == k)).alias(k) for k in "FOP"])
    both = wide.withColumn("pos", F.lit(0)).unionByName(wide.select("quarter", *[F.lit("0").alias(k) for k in "FOP"]).withColumn("pos", F.lit(1)))
    return readers.wide_to_long(both, "quarter", list("FOP"))[0]


WIDE = "select s.k as series, year(o_orderdate) || '-T' || quarter(o_orderdate) as period, sum((o_orderstatus = s.k)::int) + 0.5::double as value from orders cross join (select unnest(['F', 'O', 'P']) as k) s group by 1, 2"


def table_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and content hash of every table (the hash has no SQL twin: the count is compared)."""
    names = ("region", "nation", "orders", "lineitem", "documents", "pages")
    return readers.manifest({n: table(spark, sf, n) for n in names}).select("table", "n")


MANIFEST = " union all ".join(f"select '{n}' as \"table\", count(*) as n from {n}" for n in ("region", "nation", "orders", "lineitem", "documents", "pages"))


def vector_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a vector and vectors without a document."""
    return readers.corpus_mismatch(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), table(spark, sf, "documents").select(F.col("doc_id").alias("id"))).groupBy("problem").agg(F.count("*").alias("n"), F.min("id").alias("first"))


COVERAGE = """select problem, count(*) as n, min(id) as first from (select vec_id as id, 'extra' as problem from embeddings where vec_id not in (select doc_id from documents)
union all select doc_id, 'missing' from documents where doc_id not in (select vec_id from embeddings)) group by problem"""

QUERIES = {"live_peaks": (live_peaks, PEAKS), "live_reviews": (live_reviews, _reviews_sql()), "wide_series": (wide_series, WIDE), "table_manifest": (table_manifest, MANIFEST), "vector_coverage": (vector_coverage, COVERAGE)}
