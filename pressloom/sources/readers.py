"""Readers with fixed schemas, and the shapes that captures of feeds and statistics come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions.text import parse_number
from pressloom.functions.urls import belongs_to_outlet

RSS = "link string, title string, pubDate string, description string"
SITEMAP = "loc string, `news:news` struct<`news:title`: string, `news:publication_date`: string>"
MONTHLY_SITEMAP = "loc string, lastmod string, `image:image` struct<`image:title`: string>"
POSTS = "link string, title struct<rendered: string>, date_gmt string, modified_gmt string, categories array<bigint>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """Header, quotes doubled; empty cells are NULL."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", encoding).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in the contract's order; NULL as an empty cell."""
    df.select(*columns).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features flattened: id, magnitude, time, place, longitude, latitude, depth."""
    schema = "features array<struct<id: string, properties: struct<mag: double, time: bigint, place: string, status: string>, geometry: struct<coordinates: array<double>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return f.select("f.id", F.col("f.properties.mag").alias("magnitude"), F.timestamp_millis("f.properties.time").alias("time"), "f.properties.place", F.try_element_at(at, F.lit(1)).alias("longitude"), F.try_element_at(at, F.lit(2)).alias("latitude"), F.try_element_at(at, F.lit(3)).alias("depth"))


def latest_captures(log: DataFrame, files: DataFrame) -> DataFrame:
    """log: name, fetched_at, seq, ...; files: name. The last log line of each name whose bytes still exist."""
    order = Window.partitionBy("name").orderBy(F.desc("seq"))
    return log.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k").join(files.select("name").distinct(), "name", "left_semi")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items with a link: url, title, published (as it stands), description."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path)
    return rows.where("link is not null").select(F.trim("link").alias("url"), "title", rss_date(F.col("pubDate")).alias("published"), "description", F.lit("feed").alias("origin"))


def read_news_sitemap(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "url").schema(SITEMAP).load(path)
    n = F.col("`news:news`")
    return rows.where("loc is not null").select(F.trim("loc").alias("url"), n["news:title"].alias("title"), iso_date(n["news:publication_date"]).alias("published"), F.lit("feed").alias("origin"))


def read_monthly_sitemap(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """pages: url, published, scraped from the pages themselves; origin 'page' where one is found."""
    rows = spark.read.format("xml").option("rowTag", "url").schema(MONTHLY_SITEMAP).load(path)
    rows = rows.where("loc is not null").select(F.trim("loc").alias("url"), F.col("`image:image`")["image:title"].alias("title"), iso_date(F.col("lastmod")).alias("modified"))
    found = rows.join(pages, "url", "left")
    return found.withColumn("origin", F.when(F.col("published").isNotNull(), "page"))


def posts_with_categories(posts: DataFrame, categories: DataFrame) -> DataFrame:
    """posts: link, ..., categories (ids); categories: id, name. Names joined by ', ' in the listed order, unknown ids left out."""
    placed = posts.select("link", F.posexplode("categories").alias("k", "id")).join(categories, "id").groupBy("link").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("names"))
    return posts.drop("categories").join(placed, "link", "left").withColumn("section", F.array_join(F.transform("names", lambda x: x["name"]), ", ")).drop("names")


def index_articles(payloads: DataFrame, domain: str) -> DataFrame:
    """payloads: body (JSON). Articles of the outlet; the time seen is when it was detected, never published. A broken payload has none."""
    schema = "articles array<struct<url: string, title: string, seendate: string>>"
    rows = payloads.select(F.explode(F.from_json("body", schema, {"mode": "PERMISSIVE"})["articles"]).alias("a")).select("a.*")
    return rows.where(belongs_to_outlet(F.col("url"), F.lit(domain))).select("url", "title", F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmssX")).alias("detected"))


def knowledge_graph(lines: DataFrame) -> DataFrame:
    """lines: value, tab-separated. Rows of 27 columns or more whose third is 1: url, title out of the page title tag, time."""
    c = F.split("value", "\t")
    return lines.select(c.alias("c")).where((F.size("c") >= 27) & (F.col("c")[2] == "1")).select(F.col("c")[4].alias("url"), F.nullif(F.regexp_extract(F.col("c")[26], "<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1), F.lit("")).alias("title"), F.try_to_timestamp(F.col("c")[1], F.lit("yyyyMMddHHmmss")).alias("detected"))


def paged_observations(pages: DataFrame) -> DataFrame:
    """pages: page, rows (array of country, indicator, year, value); a later page replaces the same key."""
    rows = pages.select("page", F.inline("rows"))
    return rows.groupBy("country", "indicator", "year").agg(F.max(F.struct("page", "value"))["value"].alias("value"))


def wide_to_long(wide: DataFrame, period: str, series: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of one period and a column a series, in order `pos` -> series, period, value of first occurrences; and the repeats."""
    long = wide.unpivot(["pos", period], series, "series", "value").select("series", F.regexp_replace(period, r"^(\d{4})-Q([1-4])$", "$1-T$2").alias("period"), parse_number(F.col("value")).alias("value"), "pos")
    ranked = long.withColumn("_k", F.row_number().over(Window.partitionBy("series", "period").orderBy("pos")))
    return ranked.where("_k = 1").drop("_k", "pos"), ranked.where("_k > 1").drop("_k")


def carried_years(rows: DataFrame) -> DataFrame:
    """rows: sheet, pos, label, value: a label of four digits sets the year for the month rows below it -> sheet, year, month, value, published."""
    w = Window.partitionBy("sheet").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    year = F.last(F.when(F.col("label").rlike(r"^\s*[0-9]{4}\s*$"), F.trim("label")), ignorenulls=True).over(w)
    return rows.withColumn("year", year).where(~F.col("label").rlike(r"^\s*[0-9]{4}\s*$")).select("sheet", "year", F.lower(F.trim("label")).alias("month"), parse_number(F.col("value")).alias("value"), F.col("value").isNotNull().alias("published"))


def content_hash(columns: list[str]) -> Column:
    """Sum over rows of the first 60 bits of their SHA-256: the same whatever the order and the engine."""
    row = F.array_join(F.array(*[F.col(c).cast("string") for c in columns]), "|", "∅")
    return F.coalesce(F.sum(F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")


def manifest(tables: dict[str, DataFrame], fetched: Column | None = None) -> DataFrame:
    """table, n, hash (of the content), fetched (epoch seconds of the latest fetch; NULL if not known) and version: that day and the hash's first signs."""
    at = F.lit(None).cast("long") if fetched is None else fetched.cast("long")
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n"), content_hash(df.columns).alias("hash")).select(F.lit(name).alias("table"), "n", "hash", at.alias("fetched"))
        out = row if out is None else out.unionByName(row)
    day = F.expr("date_format(timestampadd(SECOND, fetched, TIMESTAMP_NTZ'1970-01-01 00:00:00'), 'yyyy-MM-dd')")
    return out.withColumn("version", F.concat_ws("-", day, F.substring(F.sha2("hash", 256), 1, 8)))


def refreshed(old: DataFrame, tables: dict[str, DataFrame], fetched: Column | None = None) -> DataFrame:
    """The manifest with the named tables hashed anew and the rest kept."""
    new = manifest(tables, fetched)
    return old.join(new.select("table"), "table", "left_anti").unionByName(new)


def iso_date(c: Column) -> Column:
    """ISO with offset; without one it is UTC."""
    zoned = F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mmXXX")])
    bare = F.coalesce(*[F.try_to_timestamp(F.concat(c, F.lit(z)), F.lit(p)) for p, z in (("yyyy-MM-dd'T'HH:mm:ssXXX", "Z"), ("yyyy-MM-ddXXX", "Z"))])
    return F.coalesce(zoned, bare)


def rss_date(c: Column) -> Column:
    """RFC 822, else month/day/year - time at five hours west."""
    day = F.regexp_replace(F.trim(c), "^[A-Za-z]{3},? *", "")
    rfc = [F.try_to_timestamp(F.regexp_replace(day, "(GMT|UTC|UT)$", "+0000"), F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")]
    local = F.try_to_timestamp(F.concat(day, F.lit(" -05:00")), F.lit("MM/dd/yyyy - HH:mm XXX"))
    return F.coalesce(*rfc, local)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled records: CSV with a header where the path ends in .csv, else JSON lines; a byte order mark and blank lines are no records."""
    return read_csv(spark, path, schema) if path.rstrip("/").lower().endswith(".csv") else read_jsonl(spark, path, schema)


def unique_records(rows: DataFrame, key: str) -> DataFrame:
    """rows; raises if a key repeats."""
    again = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{key} {again[0][0]!r} occurs {again[0]['count']} times")
    return rows


def corpus_mismatch(vectors: DataFrame, corpus: DataFrame) -> DataFrame:
    """id, problem: ids with a vector alone or a text alone."""
    a, b = vectors.select("id").distinct(), corpus.select("id").distinct()
    return a.join(b, "id", "left_anti").select("id", F.lit("extra").alias("problem")).union(b.join(a, "id", "left_anti").select("id", F.lit("missing").alias("problem")))
