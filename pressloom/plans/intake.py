"""Queries over captures, text columns, addresses and official series, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.functions import urls as U
from pressloom.functions.storage import table
from pressloom.operators import merge as M
from pressloom.plans import views as V

ACC = f"translate(lower({{0}}), '{T.ACCENTED}', '{T.PLAIN}')"
TERMS = ("the", "que", "nicht", "les", "idiot")


def fold_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Folded title, its id and text budgets."""
    n = V.news(spark, sf)
    return n.select("id", T.fold(F.col("title")).alias("folded"), F.substring(F.sha1("title"), 1, 12).alias("title_id"), T.word_count(F.col("title")).cast("long").alias("words"), T.spoken_seconds(F.col("title")).alias("seconds"), F.when(T.word_count(F.col("title")) > 20, "over").otherwise("within").alias("budget"))


FOLD_TITLES = V.with_(V.NEWS) + f"""select id, {ACC.format('title')} as folded, substr(sha1(title), 1, 12) as title_id,
  len(list_filter(string_split_regex(title, '\\s+'), lambda x: x <> '')) as words, ceil(len(list_filter(string_split_regex(title, '\\s+'), lambda x: x <> '')) / 2.5)::bigint as seconds,
  case when len(list_filter(string_split_regex(title, '\\s+'), lambda x: x <> '')) > 20 then 'over' else 'within' end as budget from news"""


def keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    """The first of a list of terms that stands in the body as a whole word."""
    n = V.news(spark, sf).withColumn("term", T.matched_word(F.concat_ws("\n", "title", "body"), TERMS))
    return n.where("term is not null").select("id", "term")


KEYWORDS = V.with_(V.NEWS) + f"""select id, term from (select id, nullif(regexp_extract({ACC.format("(title || chr(10) || body)")}, '{T.word_pattern(TERMS)}', 1), '') as term from news) where term is not null"""


def folded_any(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts folded beyond Western letters, by length and hash."""
    return table(spark, sf, "documents").select("doc_id", T.fold_any(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("hash"))


FOLDED_ANY = "select doc_id, length(t) as n, md5(t) as hash from (select doc_id, strip_accents(lower(replace(text, 'ß', 'ss'))) as t from documents)"


def stemmed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Number of index terms of a text, and its distinct ones."""
    n = V.news(spark, sf).withColumn("t", T.tokens(F.concat_ws("\n", "title", "body")))
    return n.select("id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("terms"))


STEM_SQL = "case when w[-6:] = 'ciones' then w[:-3] when length(w) > 4 and w[-2:] = 'es' and w[-3] not in ('a', 'e', 'i', 'o', 'u') then w[:-3] when length(w) > 3 and w[-1:] = 's' and w[-3:] <> 'sis' then w[:-2] else w end"
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def tokens_sql(c: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({ACC.format(c)}, '[a-z0-9]+'), lambda w: w not in ({STOP})), lambda w: {STEM_SQL})"


STEMMED = V.with_(V.NEWS) + f"select id, len(t) as n, array_to_string(list_sort(list_distinct(t)), ' ') as terms from (select id, {tokens_sql('(title || chr(10) || body)')} as t from news)"


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical address, validity, section, outlet test and content id."""
    p, u = table(spark, sf, "pages"), F.col("url")
    return p.select("page_id", U.canonical_url(u).alias("canon"), U.valid_http_url(u).alias("valid"), U.section_of(u).alias("section"), U.belongs_to_outlet(u, F.lit("www.Therou.example.com")).alias("own"), U.own_outlet(F.concat(F.lit("Outlet "), F.pmod("page_id", F.lit(9)).cast("string")), u, ("outlet 3",), "example.org").alias("named"), U.content_id("N-", U.canonical_url(u)).alias("id"))


PAGE_URLS = f"""select page_id, {V.CANONICAL.format('url')} as canon, {V.VALID.format('url')} as valid,
  case when len(parts) >= 2 then parts[1] end as section, {V.HOST.format('url')} = 'therou.example.com' as own, page_id % 9 = 3 or {V.HOST.format('url')} = 'example.org' or ends_with({V.HOST.format('url')}, '.example.org') as named, 'N-' || substr(sha1({V.CANONICAL.format('url')}), 1, 12) as id
from (select *, list_filter(string_split({V.PATH.format('url')}, '/'), lambda x: x <> '') as parts from pages)"""


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    """Plain text of a page's first heading and of its footer."""
    p = table(spark, sf, "pages")
    return p.select("page_id", T.clean_text(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("heading"), T.clean_text(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))


def _clean_sql(c: str) -> str:
    bare = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        bare = f"replace({bare}, '{name}', '{sign}')"
    return f"nullif(trim(regexp_replace({bare}, '[ \\t\\r\\n\\f]+', ' ', 'g')), '')"


PAGE_TEXT = f"select page_id, {_clean_sql("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} as heading, {_clean_sql("regexp_extract(html, '<title>(.*?)</title>', 1)")} as title from pages"


def page_image(spark: SparkSession, sf: str) -> DataFrame:
    """Publication date and preferred image out of tags added to each page."""
    p = table(spark, sf, "pages")
    tags = F.concat(
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta property="og:image" content="https://img.example.com/'), "page_id", F.lit('.jpg">'))).otherwise(F.lit("")),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta name="twitter:image" content="/rel'), "page_id", F.lit('.png">'))).otherwise(F.concat(F.lit('<meta name="twitter:image" content="http://tw.example.com/'), "page_id", F.lit('.png">'))),
        F.when(F.col("page_id") % 5 != 0, F.concat(F.lit('{"datePublished": "2024-01-'), F.lpad((F.pmod("page_id", F.lit(28)) + 1).cast("string"), 2, "0"), F.lit('"}'))).otherwise(F.lit('<meta property="article:published_time" content="2023-12-31">')),
    )
    html = F.regexp_replace("html", "<head>", F.concat(F.lit("<head>"), tags))
    return p.select("page_id", F.length(html).alias("n"), U.page_image(html, F.col("url")).alias("image"), U.page_date(html).alias("published"))


PAGE_IMAGE = r"""with t as (select page_id, url, regexp_replace(html, '<head>', '<head>' || case when page_id % 3 = 0 then '<meta property="og:image" content="https://img.example.com/' || page_id || '.jpg">' else '' end
  || case when page_id % 2 = 0 then '<meta name="twitter:image" content="/rel' || page_id || '.png">' else '<meta name="twitter:image" content="http://tw.example.com/' || page_id || '.png">' end
  || case when page_id % 5 <> 0 then '{"datePublished": "2024-01-' || lpad((page_id % 28 + 1)::varchar, 2, '0') || '"}' else '<meta property="article:published_time" content="2023-12-31">' end) as h from pages),
x as (select *, nullif(regexp_extract(h, '<meta property="og:image" content="([^"]+)"', 1), '') as og, regexp_extract(h, '<meta name="twitter:image" content="([^"]+)"', 1) as tw from t)
select page_id, length(h) as n, coalesce(og, case when tw[1] = '/' then regexp_extract(url, '^(https?://[^/?#]*)', 1) || tw else tw end) as image, coalesce(nullif(regexp_extract(h, '"datePublished": "([^"]+)"', 1), ''), regexp_extract(h, 'article:published_time" content="([^"]+)"', 1)) as published from x"""


def merged_items(spark: SparkSession, sf: str) -> DataFrame:
    """Merged captures with date origin and reason of exclusion."""
    return M.with_exclusion(M.merge_captures(V.captures(spark, sf))).select("id", "url", "title", "moment", "origin", "modified", "first_seen", "channels", "captures", "reason")


MERGED_CTE = f"""keyed as (select *, {V.CANONICAL.format('url')} as canon, {V.VALID.format('url')} as ok from captures),
merged as (select canon, coalesce(arg_min(url, row(fetched, seq, url)) filter (where ok), arg_min(url, row(fetched, seq, url))) as url,
  arg_min(title, row(fetched, seq, url)) filter (where title is not null) as title, arg_min(published, row(fetched, seq, url)) filter (where published is not null) as feed_at,
  max(modified) as modified, min(fetched) as first_seen, max(fetched) as last_seen, array_to_string(list_sort(list(distinct channel)), '+') as channels, count(*) as captures from keyed group by canon),
items as (select 'N-' || substr(sha1(canon), 1, 12) as id, *, coalesce(feed_at, modified) as moment, case when feed_at is not null then 'feed' when modified is not null then 'lastmod' end as origin from merged),
marked as (select *, case when not {V.VALID.format('url')} then 'url' when title is null then 'title' when moment is null then 'date'
  when moment > (select max(last_seen) from items) or moment < (select max(last_seen) from items) - {M.WINDOW_S} then 'window' end as reason from items)"""
MERGED = V.with_(V.CAPTURES, MERGED_CTE) + "select id, url, title, moment, origin, modified, first_seen, channels, captures, reason from marked"


def news_quality(spark: SparkSession, sf: str) -> DataFrame:
    """A10: counts of the news quality report."""
    return M.quality_counts(M.merge_captures(V.captures(spark, sf)))


QUALITY = V.with_(V.CAPTURES, MERGED_CTE) + """select 'read' as measure, 'all' as value, sum(captures)::bigint as n from marked union all select 'unique', 'all', count(*) from marked
union all select case when reason is null then 'kept' else 'excluded' end, coalesce(reason, origin), count(*) from marked group by 1, 2"""


def outlet_days(spark: SparkSession, sf: str) -> DataFrame:
    """Per outlet, items, first and last day, days with items and days without."""
    n = V.news(spark, sf).select("outlet", F.floor((F.col("moment") - V.START) / 86400).cast("int").alias("day"))
    outlets = table(spark, sf, "documents").select(F.col("source").alias("outlet")).distinct()
    return M.source_days(n.where("outlet <> 'src3'"), outlets, 0, 29)


OUTLET_DAYS = V.with_(V.NEWS, f"d as (select outlet, ((moment - {V.START}) // 86400)::int as day from news where outlet <> 'src3')", "o as (select distinct source as outlet from documents)") + """
select o.outlet, count(d.day) as n, min(d.day) as first, max(d.day) as last, count(distinct d.day)::int as days,
  (select coalesce(string_agg(x::varchar, ',' order by x), '') from (select unnest(range(0, 30)) as x) where x not in (select day from d d2 where d2.outlet = o.outlet)) as missing
from o left join d on d.outlet = o.outlet group by o.outlet"""


def year_on_year(spark: SparkSession, sf: str) -> DataFrame:
    """Change to the same month a year before, NULL if that one is absent or zero."""
    s = V.series(spark, sf)
    before = s.select("series", (F.col("year") + 1).alias("year"), "month", F.col("value").alias("base"))
    return s.join(before, ["series", "year", "month"], "left").select("series", "period", F.round((F.col("value") / F.nullif("base", F.lit(0.0)) - 1) * 100, 4).alias("change"))


YEAR_ON_YEAR = V.with_(V.SERIES) + "select s.series, s.period, round((s.value / nullif(b.value, 0) - 1) * 100, 4) as change from series s left join series b on b.series = s.series and b.year + 1 = s.year and b.month = s.month"


def latest_points(spark: SparkSession, sf: str) -> DataFrame:
    """Newest point of each series, with number and period in words."""
    s = V.series(spark, sf).where("value is not null")
    last = s.groupBy("series").agg(F.max(F.struct("period", "value")).alias("p"))
    return last.select("series", F.col("p.period").alias("period"), T.spanish_number(F.col("p.value")).alias("number"), T.spanish_period(F.col("p.period")).alias("words"))


MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in T.MONTHS) + "]"
LATEST = V.with_(V.SERIES) + f"""select series, period, replace(printf('%.2f', value), '.', ',') as number, {MONTHS_SQL}[substr(period, 6, 2)::int] || ' de ' || substr(period, 1, 4) as words
from (select series, max(period) as period, arg_max(value, period) as value from series where value is not null group by series)"""


def indicator_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation, year and priority, with the number of orders if there are any; nulls are kept and counted."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    years = o.select(F.year("o_orderdate").alias("year")).distinct()
    kinds = o.select(F.col("o_orderpriority").alias("indicator")).distinct()
    counts = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("indicator")).agg(F.count("*").alias("value"))
    grid = n.select(F.col("n_nationkey").alias("c_nationkey")).crossJoin(F.broadcast(years)).crossJoin(F.broadcast(kinds))  # nations x years x priorities
    full = grid.join(counts, ["c_nationkey", "year", "indicator"], "left")
    return full.groupBy("indicator").agg(F.count("*").alias("expected"), F.count("value").alias("with_value"), F.sum(F.col("value").isNull().cast("long")).alias("missing"), F.coalesce(F.sum("value"), F.lit(0)).alias("total"))


GRID = """with years as (select distinct year(o_orderdate) as y from orders), kinds as (select distinct o_orderpriority as k from orders),
counts as (select c_nationkey, year(o_orderdate) as y, o_orderpriority as k, count(*) as v from orders join customer on o_custkey = c_custkey group by all)
select kinds.k as indicator, count(*) as expected, count(v) as with_value, sum((v is null)::int)::bigint as missing, coalesce(sum(v), 0)::bigint as total
from nation cross join years cross join kinds left join counts c on c.c_nationkey = n_nationkey and c.y = years.y and c.k = kinds.k group by kinds.k"""


def official_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of series (rows, first, last, periods without a value) and of catalog events (kept, excluded, magnitudes)."""
    s = V.series(spark, sf).withColumn("value", F.when(F.col("month") % 6 != 0, F.col("value")))
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("magnitude", F.round("value", 1))
    return M.series_quality(s).unionByName(M.event_quality(e.select(F.col("event_id").alias("event"), "magnitude", F.floor(F.expr(V.MICROS) / 1_000_000).alias("moment")), least=2.5, since=V.START + 86400))


QUALITY_OFFICIAL = V.with_(V.SERIES) + f"""select 'series' as kind, series as name, count(*) as rows, min(period) as first, max(period) as last, count(*) filter (where month % 6 = 0) as missing, coalesce(string_agg(period, ',' order by period) filter (where month % 6 = 0), '') as listed from series group by series
union all select 'events', case when m < 2.5 then 'magnitude' when s < {V.START + 86400} then 'window' else 'kept' end, count(*), min(s)::varchar, max(s)::varchar, count(*) filter (where m is null), min(printf('%.1f', m)) || '-' || max(printf('%.1f', m)) from (select round(value, 1) as m, epoch_us(ts) // 1000000 as s from events where event_type = 'error') group by 2"""


def first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each key is kept, later ones are reported. Here: lines of an order that repeat its part's supplier."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    w = Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", "l_partkey")
    return li.withColumn("seq", F.row_number().over(w)).where("seq > 1").select("l_orderkey", "l_suppkey", "l_linenumber", F.col("seq").cast("long").alias("seq"))


FIRST_OCC = "select l_orderkey, l_suppkey, l_linenumber, seq from (select *, row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber, l_partkey) as seq from lineitem) where seq > 1"


def parsed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics cells in several notations, read back."""
    p = table(spark, sf, "part").select("p_partkey", F.format_number(F.col("p_retailprice") * 10, 2).alias("en"))
    es = F.translate("en", ",.", ".,")
    return p.select("p_partkey", T.parse_number(F.col("en")).alias("en"), T.parse_number(es).alias("es"), T.parse_number(F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("..")).alias("none"))


NUMBERS = "select p_partkey, round(p_retailprice * 10, 2) as en, round(p_retailprice * 10, 2) as es, null::double as none from part"

QUERIES = {
    "folded_any": (folded_any, FOLDED_ANY),
    "fold_titles": (fold_titles, FOLD_TITLES), "keyword_match": (keyword_match, KEYWORDS), "stemmed_tokens": (stemmed_tokens, STEMMED), "page_urls": (page_urls, PAGE_URLS),
    "page_text": (page_text, PAGE_TEXT), "page_image": (page_image, PAGE_IMAGE), "merged_items": (merged_items, MERGED), "news_quality": (news_quality, QUALITY), "outlet_days": (outlet_days, OUTLET_DAYS),
    "year_on_year": (year_on_year, YEAR_ON_YEAR), "latest_points": (latest_points, LATEST), "indicator_grid": (indicator_grid, GRID), "official_quality": (official_quality, QUALITY_OFFICIAL), "first_occurrence": (first_occurrence, FIRST_OCC), "parsed_numbers": (parsed_numbers, NUMBERS),
}
