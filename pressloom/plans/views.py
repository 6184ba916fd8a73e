"""Stand-ins for news tables built from the generic test tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.storage import table

#: Microseconds of a time without zone, whatever the zone of the session.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
START = 1704067200  # 2024-01-01 00:00 UTC


def news(spark: SparkSession, sf: str) -> DataFrame:
    """id, title, body, outlet, lang, at (epoch seconds over 30 days)."""
    d = table(spark, sf, "documents")
    title = F.split("text", "\n")[0]
    return d.select(F.col("doc_id").alias("id"), title.alias("title"), F.substring("text", F.length(title) + 2, F.length("text")).alias("body"), F.col("source").alias("outlet"), "lang", (F.lit(START) + F.pmod(F.col("doc_id") * 43, F.lit(43200)) * 60).alias("moment"))


NEWS = f"""news as (select doc_id as id, string_split(text, chr(10))[1] as title, substr(text, length(string_split(text, chr(10))[1]) + 2) as body,
  source as outlet, lang, {START} + ((doc_id * 43) % 43200) * 60 as moment from documents)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """id, v (doubles), label, at."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label", (F.lit(START) + F.pmod(F.col("vec_id") * 43, F.lit(43200)) * 60).alias("moment"))


VECTORS = f"vectors as (select vec_id as id, embedding::double[] as v, label, {START} + ((vec_id * 43) % 43200) * 60 as moment from embeddings)"


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """Two captures of each page: url, fetched (epoch seconds), seq, channel, title, published and modified (epoch seconds, nullable)."""
    p = table(spark, sf, "pages")
    title = F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit(""))
    first = p.select("page_id", "url", (F.lit(START) + F.col("page_id") * 3600).alias("fetched"), F.lit(0).alias("seq"), F.lit("feed").alias("channel"), F.when(F.col("page_id") % 3 != 0, title).alias("title"), F.when(F.col("page_id") % 2 == 0, F.lit(START) + F.col("page_id") * 3000).alias("published"), F.lit(None).cast("long").alias("modified"))
    again = F.concat(F.regexp_replace("url", "^https?://", "https://www."), F.when(F.col("url").rlike("[?#]"), F.lit("")).otherwise(F.lit("/")))
    second = p.select("page_id", again.alias("url"), (F.lit(START + 86400) + F.col("page_id") * 3600).alias("fetched"), F.lit(1).alias("seq"), F.lit("sitemap").alias("channel"), title.alias("title"), F.lit(None).cast("long").alias("published"), (F.lit(START) + F.col("page_id") * 3500).alias("modified"))
    return first.unionByName(second)


CAPTURES = f"""captures as (
  select page_id, url, {START} + page_id * 3600 as fetched, 0 as seq, 'feed' as channel,
    case when page_id % 3 <> 0 then nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') end as title,
    case when page_id % 2 = 0 then {START} + page_id * 3000 end as published, null::bigint as modified from pages
  union all
  select page_id, regexp_replace(url, '^https?://', 'https://www.') || case when regexp_matches(url, '[?#]') then '' else '/' end,
    {START + 86400} + page_id * 3600, 1, 'sitemap', nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), null, {START} + page_id * 3500 from pages)"""
HOST = r"regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)', 1)), '^www\.', '')"
PATH = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^?#\s]*)', 1)"
VALID = r"(regexp_matches({0}, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#@\s:]+(:[0-9]+)?([/?#].*)?$') and not regexp_matches({0}, '[\s\x00-\x1f\x7f]'))"
CANONICAL = f"case when {VALID} then {HOST} || regexp_replace({PATH}, '/+$', '') else 'invalid:' || {{0}} end"


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Calls: id, model, at (epoch microseconds), status, cache, latency, tokens."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(5))).alias("model"), F.expr(MICROS).alias("us"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.when(F.col("event_type") == "view", "hit").otherwise("miss").alias("cache"),
        F.col("value").alias("latency"), F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)).alias("tokens"),
    )


LEDGER = """ledger as (select event_id as id, 'm' || (user_id % 5) as model, epoch_us(ts) as us, case when event_type = 'error' then 'error' else 'ok' end as status,
  case when event_type = 'view' then 'hit' else 'miss' end as cache, value as latency, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as tokens from events)"""


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions: case_id, state, at (epoch microseconds), seq, version."""
    e = table(spark, sf, "events")
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return e.select(F.col("user_id").alias("case_id"), state[F.col("event_type")].alias("state"), F.expr(MICROS).alias("us"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 2500).alias("version"))


STATES = {"signup": "nuevo", "view": "en_revision", "click": "requiere_evidencia", "purchase": "aprobado_como_borrador", "error": "descartado"}
REVIEWS = "reviews as (select user_id as case_id, case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in STATES.items()) + " end as state, epoch_us(ts) as us, event_id as seq, event_id // 2500 as version from events)"


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly sums by priority: series, period, year, month, value; some months left out."""
    o = table(spark, sf, "orders")
    m = o.select(F.col("o_orderpriority").alias("series"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    return m.groupBy("series", "period", "year", "month").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("value")).where(F.pmod(F.col("year") * 12 + F.col("month"), F.lit(11)) != 0)


SERIES = """series as (select o_orderpriority as series, strftime(o_orderdate, '%Y-%m') as period, year(o_orderdate)::int as year, month(o_orderdate)::int as month,
  round(sum(o_totalprice::decimal(18,2)), 2)::double as value from orders where (year(o_orderdate) * 12 + month(o_orderdate)) % 11 <> 0 group by 1, 2, 3, 4)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
