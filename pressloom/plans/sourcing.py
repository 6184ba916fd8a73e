"""Evidence, official context, sources and what texts announce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.storage import table
from pressloom.functions.text import MONTHS, word_pattern
from pressloom.operators import context as C
from pressloom.operators import evidence as E
from pressloom.operators import exports as X
from pressloom.plans import views as V
from pressloom.plans.intake import ACC

AGENCIES, PLACES, NAMES = ("And", "The", "Les", "Der", "Que"), ("anea", "the and"), ("Eriner", "Is")
OTHERS, REGIONS = ("colombia", "peru"), ("chiriqui", "los santos")
HOME = "Panamá"


def _iso(moment: str) -> Column:
    """ISO text of epoch seconds, whatever the zone of the session."""
    return F.expr(f"date_format(timestampadd(SECOND, {moment}, TIMESTAMP_NTZ'1970-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")


def _iso_sql(moment: str) -> str:
    return f"strftime(make_timestamp(({moment}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def _word_sql(terms: tuple[str, ...]) -> str:
    return E.exact_word(terms).replace("'", "''")


def _news(spark: SparkSession, sf: str) -> DataFrame:
    n = V.news(spark, sf)
    return n.select(F.concat(F.lit("N-"), "id").alias("id"), "title", F.concat(F.lit("https://"), "outlet", F.lit(".example.com/"), "id").alias("url"), "outlet", "moment", _iso("moment").alias("published"), F.when(F.col("id") % 4 == 0, _iso("moment + 60")).alias("detected"), F.col("body").alias("description"))


def _official(spark: SparkSession, sf: str) -> DataFrame:
    """Balances of suppliers as indicators, monthly orders as series, error events as earthquakes."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    balance = s.where("s_nationkey % 5 <> 0").groupBy("s_nationkey").agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("value"))
    i = n.join(balance, n["n_nationkey"] == balance["s_nationkey"], "left").select(F.replace("n_name", F.lit(" "), F.lit("_")).alias("country"), F.lit("SUP.BAL").alias("indicator"), F.lit("Saldo de proveedores").alias("label"), F.lit("2024").alias("year"), "value", F.lit("USD").alias("unit"), F.lit("https://example.org/i").alias("url"))
    p = V.series(spark, sf).select(F.col("series").alias("series_id"), F.concat(F.lit("Pedidos "), "series").alias("series"), "period", "value", F.lit("USD").alias("unit"), F.lit("2020").alias("base"), F.lit("mensual").alias("frequency"), F.lit("https://example.org/s").alias("url"))
    q = _quakes(spark, sf)
    return E.indicator_evidence(i).unionByName(E.series_evidence(p)).unionByName(E.quake_evidence(q))


def _quakes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("moment", F.floor(F.expr(V.MICROS) / 1_000_000))
    place = F.concat(F.lit("Zona "), F.pmod("user_id", F.lit(30)).cast("string"), F.when(F.col("user_id") % 3 == 0, F.lit(", Panamá")).otherwise(F.lit("")))
    point = lambda base, k: F.when(F.col("event_id") % 4 != 0, ((F.lit(base) + F.pmod("event_id", F.lit(k))) / 10).cast("decimal(5,1)"))
    return e.select(F.col("event_id").cast("string").alias("id"), place.alias("place"), F.round("value", 1).alias("magnitude"), "moment", _iso("moment").alias("time"), F.when(F.col("event_id") % 2 == 0, "reviewed").otherwise("automatic").alias("status"), point(60, 50).alias("latitude"), point(-840, 80).alias("longitude"), F.lit("https://example.org/q").alias("url"))


QUAKES = f"""quakes as (select event_id, 'USGS-' || event_id as evidence, 'Zona ' || (user_id % 30) || case when user_id % 3 = 0 then ', Panamá' else '' end as place, round(value, 1) as magnitude, epoch_us(ts) // 1000000 as moment,
  case when event_id % 2 = 0 then 'reviewed' else 'automatic' end as status, case when event_id % 4 <> 0 then ((60 + event_id % 50)::decimal(9,1) / 10)::decimal(5,1) end as lat, case when event_id % 4 <> 0 then ((-840 + event_id % 80)::decimal(9,1) / 10)::decimal(5,1) end as lon from events where event_type = 'error')"""


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every citable record with hashes of its fields and of the sentence it is embedded as; an official record wins over a report of its id."""
    official = _official(spark, sf)
    news = E.news_evidence(_news(spark, sf))
    clash = news.where("evidence in ('N-1', 'N-2')").withColumn("evidence", F.replace("evidence", F.lit("N-"), F.lit("INEC-1-URGENT-1992-0")))
    every = X.official_first(news.unionByName(clash), official)
    text = E.evidence_text(every, {"CANADA": "Canadá", "PERU": "Perú"}, HOME)
    fields = F.sha1(F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat_ws("=", x["key"], x["value"])), "|"))
    return every.join(text, "evidence").select("evidence", "kind", "title", "moment", fields.alias("fields"), F.sha1("text").alias("text"))


_DOC_TEXT = "case when coalesce(body, '') = '' then title else title || '. ' || body end"
_PERIOD = f"(['{"', '".join(MONTHS)}'])[substr(period, 6, 2)::int] || ' de ' || substr(period, 1, 4)"
EVIDENCE = V.with_(V.NEWS, V.SERIES, QUAKES) + f""", bal as (select s_nationkey as k, sum(s_acctbal::decimal(18,2))::double as value from supplier where s_nationkey % 5 <> 0 group by 1),
ind as (select replace(n_name, ' ', '_') as c, coalesce(replace(printf('%.2f', value), '.', ','), '') as v from nation left join bal on k = n_nationkey),
n as (select 'N-' || id as e, *, {_iso_sql('moment')} as pub, case when id % 4 = 0 then {_iso_sql('moment + 60')} end as det from news),
nn as (select e, title, moment, array_to_string(list_filter(['descripcion=' || nullif(body, ''), 'fecha_deteccion=' || det, 'fecha_publicacion=' || pub, 'medio=' || outlet, 'titulo=' || title], lambda x: x is not null), '|') as f, {_DOC_TEXT} as t from n),
news_ev as (select * from nn union all select replace(e, 'N-', 'INEC-1-URGENT-1992-0'), title, moment, f, t from nn where e in ('N-1', 'N-2')),
off as (select 'WB-' || c || '-SUP.BAL-2024' as e, 'indicador' as kind, 'Saldo de proveedores (' || c || ', 2024)' as title, null::bigint as moment, 'indicador=Saldo de proveedores|periodo=2024|unidad=USD|valor=' || v as f,
    'Saldo de proveedores de ' || case c when 'CANADA' then 'Canadá' when 'PERU' then 'Perú' else c end || ' en 2024: ' || v || ' USD (Banco Mundial)' as t from ind
  union all select 'INEC-' || series || '-' || period, 'serie_inec', 'Pedidos ' || series || ' (' || period || ')', null, 'base=2020|frecuencia=mensual|periodo=' || period || '|serie=Pedidos ' || series || '|unidad=USD|valor=' || v, 'Pedidos ' || series || ' de {HOME} en ' || {_PERIOD} || ': ' || v || ' USD (INEC)'
    from (select *, replace(printf('%.2f', value), '.', ',') as v from series)
  union all select evidence, 'sismo', 'Sismo ' || place, moment, 'estado=' || status || '|hora_utc=' || iso || case when lat is not null then '|latitud=' || lat || '|longitud=' || lon else '' end || '|lugar=' || place || '|periodo=' || substr(iso, 1, 10) || '|unidad=magnitud|valor=' || v,
    'Sismo de magnitud ' || v || ' en ' || place || ', ' || substr(iso, 1, 10) || ' (USGS)' from (select *, {_iso_sql('moment')} as iso, replace(printf('%.1f', magnitude), '.', ',') as v from quakes))
select e as evidence, kind, title, moment, sha1(f) as fields, sha1(t) as text from off union all select e, 'noticia', title, moment, sha1(f), sha1(t) from news_ev where e not in (select e from off)"""


def _told(spark: SparkSession, sf: str) -> DataFrame:
    """Reports with a sentence about an earthquake, here or elsewhere, added to some."""
    n, k = V.news(spark, sf), F.pmod("id", F.lit(60))
    said = F.when(F.col("id") % 5 == 0, F.concat(F.lit(" Hubo un sismo de magnitud "), F.floor(k / 10).cast("string"), F.lit(","), F.pmod(k, F.lit(10)).cast("string"))).when(F.col("id") % 5 == 1, F.concat(F.lit(" Un temblor M"), F.floor(k / 10).cast("string"), F.lit("."), F.pmod(k, F.lit(10)).cast("string"))).when(F.col("id") % 5 == 2, " Sismo.").otherwise("")
    where = F.concat(F.when(F.col("id") % 7 == 0, " en Colombia").otherwise(""), F.when(F.col("id") % 11 == 0, " y Chiriquí").otherwise(""))
    return n.select("id", F.concat("title", F.lit("\n"), "body", said, where).alias("text"), F.col("lang").alias("topic"), "moment")


TOLD = """told as (select id, title || chr(10) || body || case id % 5 when 0 then ' Hubo un sismo de magnitud ' || (id % 60 // 10) || ',' || (id % 60 % 10) when 1 then ' Un temblor M' || (id % 60 // 10) || '.' || (id % 60 % 10) when 2 then ' Sismo.' else '' end
  || case when id % 7 = 0 then ' en Colombia' else '' end || case when id % 11 = 0 then ' y Chiriquí' else '' end as text, lang as topic, moment from news)"""
RULES = [
    C.Rule("sismo", ("sismo", "temblor"), (), (("nearest", ""),), "no event of the catalog is near"), C.Rule("precios", ("the and", "idiot", "is"), ("en",), (("latest", "INEC-1-URGENT-"), ("latest", "INEC-2-HIGH-"))),
    C.Rule("comercio", ("que", "of"), (), (("latest", "WB-NOPE-"), ("latest", "INEC-3-MEDIUM-"))), C.Rule("nada", ("nicht", "les"), ("de", "fr"), (("latest", "WB-NOPE-"),), "nothing measures it"), C.Rule("otra", ("der", "is"), (), (("latest", "INEC-1-URGENT-"),)),
]


def group_context(spark: SparkSession, sf: str) -> DataFrame:
    """Links of reports to official records by rule, or the reason for none."""
    quakes = _quakes(spark, sf)
    catalog = quakes.select(F.concat(F.lit("USGS-"), "id").alias("event"), "moment", "magnitude", C.in_country(F.col("place"), F.col("latitude"), F.col("longitude")).alias("home"))
    links, reasons = C.link_context(_told(spark, sf), RULES, _official(spark, sf), catalog, OTHERS, REGIONS)
    return links.withColumn("reason", F.lit(None).cast("string")).unionByName(reasons.select("id", F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("word"), "reason"))


def _context_sql() -> str:
    fired = " union all ".join(f"""select id, {i} as ord, '{r.name}' as rule, regexp_extract(f, '{word_pattern(r.words)}', 1) as word from own where {f"topic in ({', '.join(repr(t) for t in r.topics)})" if r.topics else 'true'}""" for i, r in enumerate(RULES))
    steps = " union all ".join(f"select {i} as ord, {k} as k, '{kind}' as kind, '{prefix}' as prefix" for i, r in enumerate(RULES) for k, (kind, prefix) in enumerate(r.finders))
    nones = " ".join(f"when {i} then '{r.none}'" for i, r in enumerate(RULES))
    number = "([0-9]+(?:[.,][0-9]+)?)"
    return V.with_(V.NEWS, V.SERIES, QUAKES, TOLD) + f""", marked as (select *, {ACC.format('text')} as f from told),
own0 as (select *, regexp_matches(f, '{word_pattern(OTHERS)}') and not regexp_matches(f, '{word_pattern(REGIONS)}') as foreign_ from marked), own as (select * from own0 where not foreign_),
fired as (select * from ({fired}) where word <> ''), steps as ({steps}),
latest as (select 'INEC-' || series || '-' as prefix, 'INEC-' || series || '-' || max(period) as evidence from series group by series),
stated as (select id, moment, list_transform(regexp_extract_all(f, 'magnitud\\s+(?:de\\s+)?{number}', 1) || regexp_extract_all(f, '{number}\\s*(?:grados|de magnitud|en la escala)', 1) || regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_])M\\s?{number}', 1), lambda x: replace(x, ',', '.')::double) as m from own),
home as (select * from quakes where contains({ACC.format('place')}, 'panama') or (lat between 7.0 and 9.7 and lon between -83.1 and -77.1)),
near as (select s.id, h.evidence from stated s join home h on abs(s.moment - h.moment) <= 86400 and (len(m) = 0 or len(list_filter(m, lambda x: round(abs(x - h.magnitude), 1) <= 0.3)) > 0) qualify row_number() over (partition by s.id order by abs(s.moment - h.moment), h.evidence) = 1),
found as (select f.id, f.ord, rule, word, k, coalesce(l.evidence, n.evidence) as evidence from fired f join steps s using (ord) left join latest l on s.kind = 'latest' and l.prefix = s.prefix left join near n on s.kind = 'nearest' and n.id = f.id where coalesce(l.evidence, n.evidence) is not null),
first as (select * from found qualify row_number() over (partition by id, ord order by k) = 1), links as (select * from first qualify row_number() over (partition by id, evidence order by ord) = 1),
unfound as (select id, min(ord) as ord from fired where (id, ord) not in (select id, ord from first) group by id)
select id, evidence, rule, word, null::varchar as reason from links union all
select o.id, null, null, null, case when o.foreign_ then '{C.FOREIGN}' else coalesce(case u.ord {nones} end, '{C.NONE}') end from own0 o left join unfound u on u.id = o.id where o.id not in (select id from links)"""


def announcements(spark: SparkSession, sf: str) -> DataFrame:
    """Reports that announce a date after the cutoff or an alert, name a place, or show the scale of an event."""
    n = V.news(spark, sf)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), (F.pmod("id", F.lit(12)) + 1).cast("int"))
    said = F.concat(F.lit(" El "), (F.pmod("id", F.lit(31)) + 1).cast("string"), F.lit(" de "), month, F.when(F.col("id") % 3 == 0, F.concat(F.lit(" de "), (F.pmod("id", F.lit(4)) + 2022).cast("string"))).otherwise(""), F.when(F.col("id") % 13 == 0, F.concat(F.lit(" hay "), "id", F.lit(" familias"))).otherwise(""), F.when(F.col("id") % 17 == 0, " en la Asamblea Nacional").otherwise(""), F.when(F.col("id") % 19 == 0, " con alerta").otherwise(""))
    text = F.concat("title", F.lit("\n"), "body", said)
    return n.select("id", E.future_or_alert(text, F.lit("2024-06-15").cast("date")).alias("future"), E.mentions_place(text, PLACES, NAMES).alias("place"), E.shows_scale(text).alias("scale"))


_MONTH_LIST = "['" + "', '".join(MONTHS) + "']"
ANNOUNCED = V.with_(V.NEWS) + f""", t as (select id, title || chr(10) || body || ' El ' || (id % 31 + 1) || ' de ' || {_MONTH_LIST}[id % 12 + 1] || case when id % 3 = 0 then ' de ' || (id % 4 + 2022) else '' end || case when id % 13 = 0 then ' hay ' || id || ' familias' else '' end
  || case when id % 17 = 0 then ' en la Asamblea Nacional' else '' end || case when id % 19 = 0 then ' con alerta' else '' end as text from news), f as (select *, {ACC.format('text')} as f from t)
select id, regexp_matches(f, '{_word_sql(E.ALERTS)}') or len(list_filter(list_zip(regexp_extract_all(f, '{E.DATE}', 1), regexp_extract_all(f, '{E.DATE}', 2), regexp_extract_all(f, '{E.DATE}', 3)), lambda x: coalesce(try_cast(coalesce(nullif(x[3], ''), '2024') || '-' || lpad(list_position({_MONTH_LIST}, x[2])::varchar, 2, '0') || '-' || lpad(x[1], 2, '0') as date) > date '2024-06-15', false))) > 0 as future,
  regexp_matches(f, '{_word_sql(PLACES)}') or regexp_matches(text, '{_word_sql(NAMES)}') as place, regexp_matches(f, '{"|".join(E.SCALE)}') or regexp_matches(replace(f, 'asamblea nacional', ''), '\\bnacional\\b') as scale from f"""


def agencies(spark: SparkSession, sf: str) -> DataFrame:
    """The agency that a report names and where its content comes from."""
    t, d = F.col("title"), F.col("body")
    return V.news(spark, sf).select("id", E.agency(t, d, AGENCIES).alias("agency"), E.provenance(t, d, F.col("outlet"), AGENCIES).alias("provenance"))


AGENCY = V.with_(V.NEWS) + f"select id, nullif(a, '') as agency, coalesce(nullif(a, ''), outlet) as provenance from (select *, regexp_extract(title || chr(10) || body, '{_word_sql(AGENCIES)}', 1) as a from news)"


def group_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of groups of up to a few reports, by hash."""
    rows = V.news(spark, sf).select(F.floor(F.col("id") / 4).alias("group"), "id", "moment", "title", F.substring("body", 1, 200).alias("description"))
    return E.rows_text(rows).select("group", F.sha1("text").alias("text"))


GROUP_TEXTS = V.with_(V.NEWS) + "select id // 4 as \"group\", sha1(string_agg(title || chr(10) || substr(body, 1, 200), chr(10) order by moment, id)) as text from news group by 1"


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with their channels, records kept and latest fetch."""
    c = V.captures(spark, sf).select(F.concat(F.lit("src"), F.pmod("page_id", F.lit(25)).cast("string")).alias("source"), "channel", "fetched")
    d = table(spark, sf, "documents").select("source")
    sources = d.union(c.select("source")).distinct()
    return E.source_catalog(sources, c, d.where("source <> 'src3'"))


CATALOG = V.with_(V.CAPTURES) + """, c as (select 'src' || (page_id % 25) as source, channel, fetched from captures), s as (select source from documents union select source from c)
select s.source, (select array_to_string(list_sort(list(distinct channel)), '+') from c where c.source = s.source) as channels, (select max(fetched) from c where c.source = s.source) as fetched, (select count(*) from documents d where d.source = s.source and d.source <> 'src3') as records from s"""


def own_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Members and context of a group that exist as evidence."""
    v = V.vectors(spark, sf)
    members, links = v.select(F.pmod("id", F.lit(40)).alias("group"), "id"), v.select(F.pmod("id", F.lit(40)).alias("group"), (F.col("id") + 7).alias("evidence"))
    known = table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("evidence"))
    return E.own_sources(members, links, known).groupBy("group").agg(F.count("*").alias("n"), F.min("evidence").alias("first"), F.max("evidence").alias("last"))


OWN = """select g as "group", count(*) as n, min(e) as first, max(e) as last from (select vec_id % 40 as g, vec_id as e from embeddings union select vec_id % 40, vec_id + 7 from embeddings) where e in (select doc_id from documents where doc_id % 3 <> 0) group by g"""


def altered(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of pages that prompts would change."""
    p = table(spark, sf, "pages")
    ev = p.select(F.col("page_id").alias("evidence"), F.create_map(F.lit("html"), F.substring("html", 1, 400), F.lit("url"), F.col("url"), F.lit("title"), F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit("tail"), F.regexp_extract("html", "([a-z ]*.{3})$", 1)).alias("fields"))
    return E.altered_fields(ev, ("html", "title", "url", "tail")).groupBy("field").agg(F.count("*").alias("n"), F.min("evidence").alias("first"))


ALTERED = """with f as (select page_id, unnest([{'k': 'html', 'v': substr(html, 1, 400)}, {'k': 'url', 'v': url}, {'k': 'title', 'v': regexp_extract(html, '<title>(.*?)</title>', 1)}, {'k': 'tail', 'v': regexp_extract(html, '([a-z ]*.{3})$', 1)}]) as x from pages)
select x.k as field, count(*) as n, min(page_id) as first from f where regexp_matches(x.v, '[<>]') group by 1"""


def vector_work(spark: SparkSession, sf: str) -> DataFrame:
    """Reports whose text has a vector already reuse it; the rest is to be embedded."""
    n = V.news(spark, sf).select("id", F.col("title").alias("text"))
    known = n.where("id % 3 = 0").select("text", F.array(F.col("id").cast("double")).alias("v"))
    reused, rest = E.reused_vectors(n, known)
    return reused.select("id", F.col("v")[0].cast("long").alias("vector")).unionByName(rest.select("id", F.lit(None).cast("long").alias("vector")))


WORK = V.with_(V.NEWS) + "select n.id, k.vector from news n left join (select title, min(id) as vector from news where id % 3 = 0 group by title) k on k.title = n.title"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows that have a vector."""
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return E.labelled_vectors(l, V.vectors(spark, sf).select("id", "v")).groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.round(F.sum(F.col("v")[0]), 6).alias("sum"))


LABELLED = "select quality as label, count(*) as n, min(doc_id) as first, round(sum(embedding[1]::double), 6) as sum from labels join embeddings on vec_id = doc_id group by 1"

QUERIES = {
    "evidence_rows": (evidence_rows, EVIDENCE), "group_context": (group_context, _context_sql()), "announcements": (announcements, ANNOUNCED), "agencies": (agencies, AGENCY), "group_texts": (group_texts, GROUP_TEXTS), "source_catalog": (catalog, CATALOG),
    "own_sources": (own_sources, OWN), "altered_fields": (altered, ALTERED), "vector_work": (vector_work, WORK), "labelled_vectors": (labelled, LABELLED),
}
