"""Figures, claims and what they cite, and judgements over answers, pools and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.storage import staged, table
from pressloom.functions.text import MONTHS
from pressloom.operators import conflicts as K
from pressloom.operators import figures as N
from pressloom.operators import judging as J
from pressloom.operators import retrieval as R
from pressloom.operators import verify as X
from pressloom.plans import views as V
from pressloom.plans.casework import _pick, _pick_sql

#: Numbers in words, 1 to 50, for texts with known figures.
_ONES = ("un", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve")
WORDS = tuple(next(w for w, v in N.UNITS.items() if v == k) if k < 31 or k % 10 == 0 else f"{next(w for w, v in N.UNITS.items() if v == k // 10 * 10)} y {_ONES[k % 10 - 1]}" for k in range(1, 51))
SIMPLE = ("hecho", "declaracion")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row a line of an order, with a sentence that states its quantity in words and its price in Spanish notation."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate")])
    q, price = F.col("l_quantity").cast("int"), F.translate(F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), ",.", ".,")
    text = F.concat(F.lit("Se vendieron "), F.element_at(F.array(*[F.lit(w) for w in WORDS]), q), F.lit(" mil cajas por "), price, F.lit(" dólares, menos "), F.col("l_linenumber").cast("string"), F.lit(" %"))
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), q.alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_linenumber").alias("line"), "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", text.alias("text"))


LINES = "lines as (select l_orderkey * 10 + l_linenumber as id, l_orderkey, l_linenumber as line, max(l_quantity)::int as q, max(l_extendedprice)::decimal(18,2) as price, max(l_partkey) as p, max(l_suppkey) as s, max(l_shipdate) as d from lineitem group by l_orderkey, l_linenumber)"


def figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of sentences, in order, by line of the order."""
    per = N.figure_lists(_lines(spark, sf).select("id", "text"), "text").select("id", F.transform("figures", lambda x: x.cast("double")).alias("v"))
    return per.select("id", F.size("v").alias("n"), F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(1)).alias("second"), F.get("v", F.lit(2)).alias("third"))


FIGURES = V.with_(LINES) + "select id, 3 as n, q * 1000.0::double as first, price::double as second, -line::double as third from lines"


def value_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Written values that say the same share a key; here quantities in digits and in words, with one unit or another."""
    p = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("q"), (F.col("l_partkey") % 2).alias("unit")).distinct()
    unit = F.when(F.col("unit") == 0, " cajas").otherwise(" por ciento")
    both = p.select((F.col("q") * 10 + F.col("unit")).alias("id"), F.explode(F.array(F.concat(F.col("q").cast("string"), F.lit(".000"), unit), F.concat(F.element_at(F.array(*[F.lit(w) for w in WORDS]), F.col("q")), F.lit(" mil"), F.regexp_replace(unit, "por ciento", "%")))).alias("text"))
    return N.value_keys(both).groupBy("id").agg(F.countDistinct("key").alias("keys"), F.min("key").alias("key"))


VALUE_KEYS = "select distinct l_quantity::int * 10 + l_partkey % 2 as id, 1 as keys, (l_quantity::int * 1000) || case when l_partkey % 2 = 0 then '|cajas' else '|%' end as key from lineitem"


def _order_claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims are sentences about lines; each cites the record of its line, of which some state another quantity, and a passage of it."""
    l = staged(_lines(spark, sf))
    claims = l.select(F.col("id").alias("claim"), F.concat("text", F.when(F.col("id") % 7 == 0, F.concat(F.lit(" en "), F.year("l_shipdate").cast("string"))).otherwise(""), F.when(F.col("id") % 11 == 0, " hoy").otherwise(""), F.when(F.col("id") % 13 == 0, ". El gerente robó").otherwise(""), F.when(F.col("id") % 101 == 0, " clave XK-77").otherwise("")).alias("text"), _pick(SIMPLE, F.col("id")).alias("type"))
    evidence = l.select(F.col("id").alias("evidence"), _pick(("indicador", "noticia"), F.col("id")).alias("kind"), F.create_map(F.lit("valor"), F.concat((F.col("q") * 1000 + F.when(F.col("id") % 3 == 0, 500).otherwise(0)).cast("string"), F.lit(" cajas")), F.lit("precio"), F.col("price").cast("string"), F.lit("periodo"), F.when(F.col("id") % 5 == 0, "").otherwise(F.date_format("l_shipdate", "yyyy-MM"))).alias("fields"))
    passage = F.when(F.col("id") % 17 == 0, "otra cosa").otherwise(F.col("price").cast("string"))
    citations = l.where("id % 19 <> 0").select(F.col("id").alias("claim"), F.col("id").alias("evidence"), F.lit("precio").alias("field"), passage.alias("passage"))
    return claims, citations, evidence


def claimed_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of claims that nothing they cite supports, by figure."""
    return X.unsupported_figures(*_order_claims(spark, sf)).groupBy(X.shown(F.col("figure")).alias("figure")).agg(F.count("*").alias("n"), F.min("claim").alias("first"))


_SAID = "l0 as (select *, case when id % 5 = 0 then '' else strftime(d, '%Y-%m') end as period, id % 19 <> 0 as cites, case when id % 17 = 0 then 'otra cosa' else price::varchar end as passage from lines)"
_UNSUPPORTED = """said as (select distinct id, unnest([(q * 1000)::double, price::double, -line::double] || case when id % 7 = 0 then [year(d)::double] else [] end || case when id % 101 = 0 then [77::double] else [] end) as f from l0),
kept as (select distinct id, unnest([price::double, (q * 1000 + case when id % 3 = 0 then 500 else 0 end)::double] || case when period <> '' then [year(d)::double, month(d)::double] else [] end) as f from l0 where cites),
bare as (select * from said except select * from kept)"""
CLAIMED = V.with_(LINES, _SAID, _UNSUPPORTED) + "select regexp_replace(regexp_replace(f::decimal(18,6)::varchar, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') as figure, count(*) as n, min(id) as first from bare group by f"


def claim_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Every reason for which a claim goes."""
    issues = X.claim_issues(*_order_claims(spark, sf), canary="xk-77")
    every = issues[0]
    for more in issues[1:]:
        every = every.unionByName(more)
    return every.withColumn("reason", F.regexp_replace("reason", r"figure: .*", "figure")).groupBy("reason").agg(F.count("*").alias("n"), F.min("claim").alias("first"))


CHECKS = V.with_(LINES, _SAID, _UNSUPPORTED) + """select reason, count(*) as n, min(id) as first from (select 'citation: not literal' as reason, id from l0 where cites and id % 17 = 0 union all select 'no citation', id from l0 where not cites union all select 'figure', id from bare
union all select 'official figure without its period', id from l0 where cites and id % 2 = 0 and (period = '' or id % 7 <> 0) union all select 'official figure as of today', id from l0 where cites and id % 2 = 0 and id % 11 = 0
union all select 'accusation as a fact', id from l0 where id % 13 = 0 and id % 2 = 0 union all select 'internal canary in claim', id from l0 where id % 101 = 0) group by 1"""


def version_support(spark: SparkSession, sf: str) -> DataFrame:
    """The fewest fields of a record that carry a version's value and scope."""
    l = _lines(spark, sf)
    evidence = l.select(F.col("id").alias("evidence"), F.create_map(F.lit("all"), F.concat(F.col("q").cast("string"), F.lit(" cajas en el año "), F.year("l_shipdate").cast("string"), F.lit(" y más")), F.lit("when"), F.concat(F.lit("año "), F.year("l_shipdate").cast("string")), F.lit("what"), F.concat((F.col("q") + F.when(F.col("id") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit(" cajas"))).alias("fields"))
    versions = l.select(F.col("id").alias("version"), (F.col("id") + F.when(F.col("id") % 11 == 0, 10**9).otherwise(0)).alias("evidence"), F.when(F.col("id") % 5 == 0, "cajas").otherwise(F.concat(F.element_at(F.array(*[F.lit(w) for w in WORDS]), F.col("q")), F.lit(" cajas"))).alias("value"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("en "), F.year("l_shipdate").cast("string"))).when(F.col("id") % 13 == 0, "en 1900").otherwise("en total").alias("scope"))
    return X.supported_versions(versions, evidence).groupBy("supported", F.array_join("fields", "+").alias("fields")).agg(F.count("*").alias("n"), F.min("version").alias("first"))


# 'un' alone is no figure, and 'un cajas' stands nowhere as written
_WHAT = "case when id % 11 = 0 or (id % 7 <> 0 and id % 13 = 0) or (id % 5 <> 0 and q = 1) then 'none' when id % 5 = 0 then case when id % 7 = 0 then 'what+when' else 'what' end when id % 7 = 0 or id % 3 = 0 then 'all' else 'what' end"
VERSIONS = V.with_(LINES, f"w as (select *, {_WHAT} as f from lines)") + "select f <> 'none' as supported, case when f = 'none' then '' else f end as fields, count(*) as n, min(id) as first from w group by f"


def date_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Dates at odds between two voices; lines of an order say when it opens."""
    l = table(spark, sf, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"), F.max("l_shipdate").alias("d"))  # dealt once, by group
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month("d"))
    text = F.concat(F.lit("El puente nuevo se abrirá el "), F.dayofmonth("d").cast("string"), F.lit(" de "), month, F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" de "), F.year("d").cast("string"))).otherwise(""), F.lit(". Antes, en la plaza, el 1 de enero de 1999 cerraron las tiendas."))
    rows = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("group"), F.col("s").cast("string").alias("provenance"), F.to_date("d").alias("day"), text.alias("text"))
    return K.told_date_conflicts(rows).groupBy("key").agg(F.count("*").alias("n"), F.min("a").alias("first"))


DATE_CONFLICTS = """with l as (select l_orderkey * 10 + l_linenumber as id, l_orderkey as g, l_linenumber as k, max(l_suppkey) as s, max(l_shipdate)::date as d from lineitem group by l_orderkey, l_linenumber)
select 'abrir' as key, count(*) as n, min(a.id) as first from l a join l b on a.g = b.g and a.id < b.id and (a.s <> b.s or a.d <> b.d) where not (day(a.d) = day(b.d) and month(a.d) = month(b.d) and (a.k % 2 <> 0 or b.k % 2 <> 0 or year(a.d) = year(b.d))) having count(*) > 0"""


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a text holds an anchor, as a written number or as words."""
    p = table(spark, sf, "part")
    price = F.col("p_retailprice") * 10
    text = F.concat(F.lit("Precio "), F.format_number(price, 2), F.lit(" y "), F.col("p_name"))
    key = F.when(F.col("p_partkey") % 4 == 0, F.translate(F.format_number(price, 2), ",.", ".,")).when(F.col("p_partkey") % 4 == 1, F.upper(F.substring("p_name", 1, 6))).when(F.col("p_partkey") % 4 == 2, "nada de esto").otherwise("0,5")
    return p.select("p_partkey", J.key_present(key, text).alias("present"))


ANCHORS = "select p_partkey, p_partkey % 4 < 2 as present from part"


def safety(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that pass the check of their case; a leak never does."""
    c, k = table(spark, sf, "conversations"), F.col("conv_id") * 10 + F.col("turn")
    said = F.concat("text", F.when(k % 5 == 0, " subió 50 %").otherwise(""), F.when(k % 3 == 0, " Cerró definitivamente").otherwise(""), F.when(k % 4 == 0, " y hoy es culpable").otherwise(""), F.when(k % 11 == 0, " [Xk-77]").otherwise(""))
    rows = c.select(_pick(CHECK_NAMES, k).alias("check"), said.alias("text"), F.when(F.col("turn") % 2 == 0, "abstencion").otherwise("respondida").alias("state"))
    return rows.groupBy("check", J.safe(F.col("check"), F.col("text"), F.col("state"), "xk-77").alias("safe")).agg(F.count("*").alias("n"))


CHECK_NAMES = ("sin_canario", "no_50", "no_afirma_cierre", "atribuye_no_afirma", "sin_cita_inventada", "no_actual", "otra")
SAFETY = f"""with r as (select conv_id * 10 + turn as k, turn, {_pick_sql(CHECK_NAMES, 'conv_id * 10 + turn')} as c from conversations)
select c as "check", case when k % 11 = 0 then false when c = 'sin_canario' then true when c = 'no_50' then k % 5 <> 0 when c = 'no_afirma_cierre' then k % 3 <> 0 when c = 'atribuye_no_afirma' then k % 4 <> 0 when c = 'sin_cita_inventada' then turn % 2 = 0 when c = 'no_actual' then k % 4 <> 0 end as safe, count(*) as n from r group by 1, 2"""


def answer_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Answers and claims that cite; no value for claims while an answer is not mapped."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    rows = o.select(F.col("o_orderstatus").alias("part"), _pick(("respondida", "abstencion", "contradiccion"), k).alias("state"), (k % 5 != 0).alias("cited"), ((k % 100 != 1) | (F.col("o_orderstatus") == "F")).alias("mapped"), (k % 4).alias("n_claims"), F.least(k % 4, k % 3).alias("cited_claims"), (2 + k % 2).alias("n_versions"), (2 + k % 2).alias("cited_versions"))
    parts = [J.answer_coverage(rows.where(F.col("part") == x)).withColumn("part", F.lit(x)) for x in ("F", "O")]
    return parts[0].unionByName(parts[1])


COVERAGE = """with r as (select o_orderstatus as part, o_orderkey as k, o_orderkey % 3 as s from orders where o_orderstatus in ('F', 'O')),
a as (select part, 'answers' as measure, count(*) filter (where s = 0 and k % 5 <> 0) as passed, count(*) filter (where s = 0) as total, false as open from r group by part union all
select part, 'claims', sum(case when s = 0 then least(k % 4, k % 3) when s = 2 then 2 + k % 2 else 0 end)::bigint, sum(case when s = 0 then k % 4 when s = 2 then 2 + k % 2 else 0 end)::bigint, bool_or(s = 0 and k % 100 = 1 and part <> 'F') from r group by part)
select part, measure, passed, total, case when not open then round(passed / total, 6) end as value from a"""


def claim_support(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that cite, and reviewed ones that people support; a statement counts once."""
    n = V.news(spark, sf)
    claims = n.select(F.col("id").alias("claim"), F.col("title").alias("text"), (F.col("id") % 4 != 0).alias("cited"), F.sha2("title", 256).alias("hash"))
    reviews = claims.where("claim % 3 = 0").select("claim", F.when(F.col("claim") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"), (F.col("claim") % 7 != 0).alias("human"), _pick(("supported", "unsupported", "unclear", "maybe"), F.col("claim")).alias("verdict"))
    return J.claim_support(claims, reviews)


SUPPORT = V.with_(V.NEWS) + f""", r as (select *, id % 3 = 0 as asked, id % 3 = 0 and id % 5 <> 0 and id % 7 <> 0 and id % 4 <> 3 as sound, {_pick_sql(('supported', 'unsupported', 'unclear', 'maybe'), 'id')} as verdict from news),
f as (select arg_min(verdict, id) as v from r where sound group by lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))))
select count(*) as claims, count(*) filter (where id % 4 <> 0) as covered, (select count(*) from f) as reviewed, (select count(*) from f where v = 'supported') as supported, count(*) filter (where asked) - (select count(*) from f) as rejected,
  round(count(*) filter (where id % 4 <> 0) / count(*), 6) as coverage, round((select count(*) filter (where v = 'supported') / nullif(count(*), 0) from f), 6) as support, (select count(*) >= 30 and coalesce(count(*) filter (where v = 'supported') / nullif(count(*), 0) >= 0.9, false) from f) as meets from r"""


def pooled_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Two rankings over fully judged pools alone."""
    v = V.vectors(spark, sf).select("id", "v")
    queries, docs = v.where("id % 20 = 0").withColumnRenamed("id", "query"), v.withColumnRenamed("id", "doc")
    near = R.cosine(docs, queries, 5).select(F.lit("near").alias("method"), "query", "doc", "rank")
    fixed = queries.select(F.lit("fixed").alias("method"), "query", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.col("query") + k)).alias("rank", "doc")).select("method", "query", "doc", (F.col("rank") + 1).alias("rank"))
    rankings = staged(near.unionByName(fixed))
    grades = rankings.select("query", "doc").distinct().withColumn("grade", F.when((F.col("query") % 60 == 0) & (F.col("doc") % 3 == 0), "unknown").otherwise(F.pmod(F.col("query") + F.col("doc"), F.lit(3)).cast("string")))
    return J.pooled_measures(rankings, grades)


POOLED = V.with_(V.VECTORS) + """, cos as (select q.id as query, d.id as doc, round(list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v)), 6) as score from vectors q join vectors d on q.id % 20 = 0),
rk as (select 'near' as method, query, doc, row_number() over (partition by query order by score desc, doc) as rank from cos qualify rank <= 5 union all select 'fixed', id, id + k, k from vectors cross join range(1, 6) t(k) where id % 20 = 0),
g as (select distinct query, doc, case when query % 60 = 0 and doc % 3 = 0 then null else (query + doc) % 3 end as g from rk), done as (select query, count(*) filter (where g > 0) as relevant, list_sort(list(g), 'desc')[1:5] as best from g group by query having count(*) = count(g)),
e as (select method, r.query, count(*) filter (where g > 0) as found, sum((pow(2, g) - 1) / log2(rank + 1)) as gain from rk r join done using (query) join g using (query, doc) group by 1, 2),
i as (select query, relevant, list_sum([(pow(2, best[k]) - 1) / log2(k + 1) for k in range(1, len(best) + 1)]) as ideal from done)
select method, count(*) as queries, round(avg(found / 5), 6) as precision, round(avg(found / nullif(relevant, 0)), 6) as recall, count(*) filter (where relevant > 0) as recall_queries, round(avg(case when ideal > 0 then gain / ideal end), 6) as ndcg, count(*) filter (where ideal > 0) as ndcg_queries from e join i using (query) group by method"""


def judgement_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements of agents that cannot be used, by rule."""
    d, l, k = table(spark, sf, "documents"), table(spark, sf, "labels"), F.col("doc_id")
    items = d.select(k.alias("item"), F.when(k % 2 == 0, "retrieval").otherwise("pair").alias("kind"))
    j = l.select(k.alias("id"), (k - F.when(k % 10 == 3, 1).otherwise(0) + F.when(k % 50 == 7, 10**7).otherwise(0)).alias("item"), _pick(("0", "2", "unknown", "same_event", "7"), k).alias("grade"), F.when(k % 13 != 0, "a").otherwise(" ").alias("actor"), F.when(k % 17 != 0, "because").alias("reason"), F.when(k % 19 != 0, "s1").otherwise("s0").alias("snapshot"), F.when(k % 23 != 0, "agent").otherwise("human").alias("reviewer"))
    return J.judgement_problems(items, j, "s1").groupBy("rule").agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("first"))


JUDGEMENTS = f"""with j as (select doc_id as id, doc_id - (doc_id % 10 = 3)::int + case when doc_id % 50 = 7 then 10000000 else 0 end as item, {_pick_sql(('0', '2', 'unknown', 'same_event', '7'), 'doc_id')} as grade from labels),
k as (select *, item in (select doc_id from documents) as known from j), a as (select item, min(id) as first from j group by item having count(*) > 1)
select rule, count(*) as n, min(id) as first from (select 'other snapshot' as rule, id from k where id % 19 = 0 union all select 'not an agent''s', id from k where id % 23 = 0 union all select 'unknown item', id from k where not known union all select 'item judged twice', id from k join a using (item) where id > first
union all select 'grade not allowed', id from k where known and not (case when item % 2 = 0 then grade in ('0', '2', 'unknown') else grade in ('same_event', 'unknown') end) union all select 'no actor', id from k where id % 13 = 0 union all select 'no reason', id from k where id % 17 = 0) group by rule"""


def comparability(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps candidates from being compared."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"))
    ranks = q.select("query", F.explode(F.sequence(F.lit(0), F.when(F.col("query") % 9 == 0, 5).otherwise(4))).alias("k"))
    a = ranks.select(F.lit("a").alias("method"), "query", (F.col("query") + F.when((F.col("query") % 7 == 0) & (F.col("k") == 1), 0).otherwise(F.col("k"))).alias("doc"))
    b = ranks.where("query % 5 <> 0").select(F.lit("b").alias("method"), F.when(F.col("query") % 11 == 0, -1).otherwise(F.col("query")).alias("query"), F.when(F.col("query") % 13 == 0, -F.col("k") - 1).otherwise(F.col("k")).alias("doc"))
    pairs = q.select(F.col("query").alias("pair"))
    predictions = pairs.select(F.lit("a").alias("method"), "pair").union(pairs.where("pair % 3 <> 0").select(F.lit("b"), "pair")).union(pairs.where("pair % 20 = 0").select(F.lit("a"), -F.col("pair") - 1))
    return J.comparability_problems(q, a.union(b), d, pairs, predictions).groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first"))


COMPARABLE = """with q as (select item_id as q from benchmark), r0 as (select q, unnest(range(0, case when q % 9 = 0 then 6 else 5 end)) as k from q),
r as (select 'a' as m, q, q + case when q % 7 = 0 and k = 1 then 0 else k end as d from r0 union all select 'b', case when q % 11 = 0 then -1 else q end, case when q % 13 = 0 then -k - 1 else k end from r0 where q % 5 <> 0),
p as (select 'a' as m, q from q union all select 'b', q from q where q % 3 <> 0 union all select 'a', -q - 1 from q where q % 20 = 0), ms as (select unnest(['a', 'b']) as m),
x as (select 'query not ranked' as rule, m || '/' || q as id from ms cross join q where (m, q) not in (select m, q from r) union all select distinct 'query that nobody asked', m || '/' || q from r where q not in (select q from q) union all select 'too many documents', m || '/' || q from r group by m, q having count(*) > 5
union all select distinct 'document twice', m || '/' || q from (select m, q, d from r group by m, q, d having count(*) > 1) union all select distinct 'unknown document', m || '/' || q from r where d not in (select doc_id from documents)
union all select 'pair not predicted', m || '/' || q from ms cross join q where (m, q) not in (select m, q from p) union all select 'unknown pair', m || '/' || q from p where q not in (select q from q))
select rule, count(*) as n, min(id) as first from x group by rule"""

QUERIES = {
    "figures": (figures, FIGURES), "value_keys": (value_keys, VALUE_KEYS), "claimed_figures": (claimed_figures, CLAIMED), "claim_checks": (claim_checks, CHECKS), "version_support": (version_support, VERSIONS), "date_conflicts": (date_conflicts, DATE_CONFLICTS), "anchors": (anchors, ANCHORS), "safety": (safety, SAFETY),
    "answer_coverage": (answer_coverage, COVERAGE), "claim_support": (claim_support, SUPPORT), "pooled_measures": (pooled_measures, POOLED), "judgement_problems": (judgement_problems, JUDGEMENTS), "comparability": (comparability, COMPARABLE),
}
