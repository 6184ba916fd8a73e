"""Delivered content and its proofs, over stand-ins out of orders, lines, customers and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions.storage import table
from pressloom.operators import exports as X
from pressloom.operators import judging as J
from pressloom.operators import retrieval as R
from pressloom.operators.metrics import binary_counts
from pressloom.plans import views as V
from pressloom.plans.events import GROUPS, LEAST, PAIRS, _with_recursive
from pressloom.plans.intake import ACC


def current_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on the current version of active content, by state."""
    d = V.reviews(spark, sf).withColumnRenamed("version", "content_version")
    contents = d.select("case_id").distinct().select("case_id", F.pmod("case_id", F.lit(4)).alias("content_version"), (F.col("case_id") % 7 != 0).alias("active"))
    return X.active_decisions(contents, d).groupBy("state").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


CURRENT = V.with_(V.REVIEWS) + "select state, count(*) as n, min(seq) as first from reviews where version = case_id % 4 and case_id % 7 <> 0 group by state"


def draft_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Edited drafts over generated ones, sources once each in order. Orders are cases, their parts the sources."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    first = l.select(F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_partkey").distinct()
    sources = first.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("sources"))
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("draft")).join(sources, "case_id", "left")
    edits = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"), F.lit("edited").alias("edited"), F.array(F.lit(5).cast("long"), F.col("o_custkey")).alias("extra"))
    return X.overlaid(cases, edits).select("case_id", "draft", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


OVERLAY = """with s as (select l_orderkey as k, list(l_partkey order by l_linenumber, l_partkey) as p from (select distinct l_orderkey, l_linenumber, l_partkey from lineitem) group by 1),
j as (select o_orderkey as case_id, case when o_orderstatus = 'F' then 'edited' else o_orderpriority end as draft, coalesce(p, []) || case when o_orderstatus = 'F' then [5::bigint, o_custkey] else [] end as a from orders left join s on s.k = o_orderkey),
u as (select case_id, draft, unnest(a) as x, generate_subscripts(a, 1) as i from j), d as (select case_id, x, min(i) as i from u group by 1, 2)
select case_id, any_value(draft) as draft, coalesce((select string_agg(x::varchar, ',' order by i) from d where d.case_id = j.case_id), '') as sources from j group by case_id"""


def official_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Newer official values in place of old ones; here account balances of customers that are suppliers too."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("value"))
    return X.refreshed(rows, s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))).groupBy("kind", "replaced").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("total"))


REFRESH = "select c_mktsegment as kind, s_suppkey is not null as replaced, count(*) as n, round(sum(coalesce(s_acctbal, c_acctbal)::decimal(18,2)), 2)::double as total from customer left join supplier on s_suppkey = c_custkey group by 1, 2"


def questions_of_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that cite a source of a case. Suppliers are cases, their parts the sources, orders the answers."""
    l = table(spark, sf, "lineitem")
    answers = l.groupBy(F.col("l_orderkey").alias("answer")).agg(F.max(F.col("l_orderkey") % 5 == 0).alias("probe"), F.collect_set("l_partkey").alias("evidence"))
    sources = l.select(F.col("l_suppkey").alias("case_id"), F.col("l_partkey").alias("evidence")).distinct()
    return X.case_questions(answers, sources).groupBy("case_id").agg(F.count("*").alias("n"), F.min("answer").alias("first"))


QUESTIONS = "select case_id, count(*) as n, min(answer) as first from (select distinct s.l_suppkey as case_id, a.l_orderkey as answer from lineitem a join lineitem s on s.l_partkey = a.l_partkey where a.l_orderkey % 5 <> 0) group by case_id"


def proven_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Packages whose text is their claims in order. Orders are packages; every third text is altered."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    kind = F.when(F.col("p_partkey") % 2 == 0, "Fact: ").otherwise("Claim: ")
    claims = table(spark, sf, "part").select(F.col("p_partkey").alias("claim"), F.concat(kind, "p_name").alias("rendered"))
    parts = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("claim_ids"))
    text = l.join(claims, F.col("claim") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "rendered"))), lambda x: x["rendered"]), " ").alias("text"))
    packages = parts.join(text, "l_orderkey").select(F.col("l_orderkey").alias("package"), F.lit("body").alias("part"), F.when(F.col("l_orderkey") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"), "claim_ids")
    return X.package_proof(packages, claims).groupBy("proven").agg(F.count("*").alias("n"), F.min("package").alias("first"))


PROVEN = "select o % 3 <> 0 as proven, count(*) as n, min(o) as first from (select distinct l_orderkey as o from lineitem join part on p_partkey = l_partkey) group by 1"


def rendered_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims as they are shown, by kind and author. Parts are claims, their makers the authors."""
    kinds = F.array(*[F.lit(k) for k in ("hecho", *X.CLAIM_PREFIXES)])
    kind = F.element_at(kinds, (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", X.rendered_claim(kind, F.col("p_brand"), F.col("p_name")).alias("shown"))


RENDERED = "select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then 'Declaración atribuida a ' || p_brand || ': ' || p_name when 2 then 'Inferencia por verificar: ' || p_name else 'Hipótesis por verificar: ' || p_name end as shown from part"


def human_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels replaced by reviews of the record as it is."""
    l = table(spark, sf, "labels")
    digest = F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("quality").cast("string")), 256)
    records = l.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), digest.alias("hash"))
    stale = F.when(F.col("id") % 5 == 0, F.lit("old")).otherwise(F.col("hash"))
    reviews = records.where("id % 3 <> 0").select("id", (1 - F.col("label")).alias("new_label"), stale.alias("hash"), (F.col("id") % 7 != 0).alias("human"), F.when(F.col("id") % 11 != 0, F.col("id") * 10).alias("us"))
    return X.applied_labels(records, reviews, 1_000_000).groupBy("status", "label").agg(F.count("*").alias("n"))


LABELS = """with s as (select doc_id as id, quality as q, case when doc_id % 3 = 0 then 'original' when doc_id % 5 = 0 then 'stale' when doc_id % 7 = 0 then 'not human' when doc_id % 11 = 0 or doc_id * 10 > 1000000 then 'bad time' else 'reviewed' end as status from labels)
select status, case when status = 'reviewed' then 1 - q else q end as label, count(*) as n from s group by 1, 2"""


def answer_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of answers by verified versions and claims. Orders are answers; lines are versions keyed by flag, cited by supplier."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_returnflag", "l_suppkey", "l_partkey")])
    answers = table(spark, sf, "orders").select(F.col("o_orderkey").alias("answer"), (F.col("o_orderkey") % 10 == 0).alias("abstained"))
    versions = l.where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("key"), F.col("l_suppkey").alias("evidence"))
    claims = l.where("l_partkey % 3 = 1").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("claim"))
    return X.resolved_answers(answers, claims, versions).groupBy("state").agg(F.count("*").alias("n"), F.sum("claims").alias("claims"), F.sum("versions").alias("versions"))


ANSWERS = """with l as (select l_orderkey as a, l_linenumber as pos, max(l_returnflag) as k, max(l_suppkey) as e, max(l_partkey) as p from lineitem group by 1, 2),
v as (select a, k, arg_min(e, pos) as e from l where p % 3 = 0 group by a, k), n as (select a, count(distinct e) as versions from v group by a), c as (select a, count(*) as claims from l where p % 3 = 1 group by a),
r as (select o_orderkey % 10 = 0 as ab, coalesce(versions, 0) as versions, coalesce(claims, 0) as claims from orders left join n on n.a = o_orderkey left join c on c.a = o_orderkey)
select case when ab then 'abstencion' when versions >= 2 then 'contradiccion' when claims >= 1 then 'respondida' else 'abstencion' end as state, count(*) as n, sum(claims)::bigint as claims, sum(versions)::bigint as versions from r group by 1"""


def pair_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Same-group predictions for labelled pairs, by group and by the bonus for shared names and numbers."""
    pairs = V.vectors(spark, sf).select(F.col("id").alias("a"), F.col("label").alias("la")).join(V.vectors(spark, sf).select(F.col("id").alias("b"), F.col("label").alias("lb")), F.col("b") == F.col("a") + 10)
    from pressloom.operators.grouping import single_link

    g = single_link(V.vectors(spark, sf), LEAST)
    both = pairs.join(g.select(F.col("id").alias("a"), F.col("group").alias("ga")), "a").join(g.select(F.col("id").alias("b"), F.col("group").alias("gb")), "b")
    n = V.news(spark, sf).select("id", F.concat("title", F.lit(" "), F.substring("body", 1, 300)).alias("t")).select("id", J.names_of(F.col("t")).alias("n"), F.array_distinct(F.regexp_extract_all("t", F.lit(J.WRITTEN), F.lit(0))).alias("k"))
    told = both.join(n.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("k").alias("ka")), "a", "left").join(n.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb")), "b", "left")
    bonus = F.round(J.overlap_bonus(F.col("na"), F.col("nb"), F.col("ka"), F.col("kb")), 6)
    both = told.withColumn("rule", bonus > 0.001)
    flat = both.select(F.inline(F.array(*[F.struct(F.lit(m).alias("method"), (F.col("la") == F.col("lb")).alias("truth"), p.alias("predicted")) for m, p in (("group", F.col("ga") == F.col("gb")), ("rule", F.col("rule")))])))
    return binary_counts(flat, "method")


PAIR_EVAL = _with_recursive(V.VECTORS, V.NEWS, PAIRS, GROUPS) + f""", t as (select id, title || ' ' || substr(body, 1, 300) as t from news), ws as (select id, t, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') as w from t),
nm as (select id, list_distinct(list_transform(list_filter([case when regexp_matches(w[i - 1], '[.!?¡¿]$') then '' else regexp_extract(w[i], '^([A-ZÁÉÍÓÚÑ][\\p{{L}}\\p{{N}}_]+)', 1) end for i in range(2, len(w) + 1)], lambda x: x <> ''), lambda x: {ACC.format('x')})) as n, list_distinct(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)*')) as k from ws),
bonus as (select x.id as a, y.id as b, round(0.08 * len(list_intersect(x.n, y.n)) / greatest(1, len(list_distinct(x.n || y.n))) - case when len(x.k) > 0 and len(y.k) > 0 and len(list_intersect(x.k, y.k)) = 0 then 0.04 else 0 end, 6) as v from nm x join nm y on y.id = x.id + 10),
p as (select a.label = b.label as truth, ga.grp = gb.grp as same, bonus.v > 0.001 as rule from vectors a join vectors b on b.id = a.id + 10 join grp ga on ga.id = a.id join grp gb on gb.id = b.id left join bonus on bonus.a = a.id),
f as (select 'group' as method, truth, same as pr from p union all select 'rule', truth, rule from p),
c as (select method, sum((coalesce(pr, false) and truth)::int)::bigint as tp, sum((coalesce(pr, false) and not truth)::int)::bigint as fp, sum((not coalesce(pr, false) and truth)::int)::bigint as fn, sum((not coalesce(pr, false) and not truth)::int)::bigint as tn, sum((pr is null)::int)::bigint as missing from f group by method),
r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as q from c)
select method, tp, fp, fn, tn, missing, round(p, 6) as precision, round(q, 6) as recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) as f1 from r"""


def zero_shot(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest description vector of each report, and how many links a threshold leaves. The first ten vectors describe the topics."""
    v = V.vectors(spark, sf).select("id", "v")
    best = R.nearest(v.where("id < 10").withColumnRenamed("id", "doc"), v.where("id >= 10").withColumnRenamed("id", "query"), 1)
    levels = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.2, 0.3)]))
    return best.select(F.col("doc").alias("topic"), "score", levels.alias("least")).where("score >= least").groupBy("topic", "least").agg(F.count("*").alias("n"))


ZERO_SHOT = V.with_(V.VECTORS) + """, b as (select q.id, d.id as topic, round(list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v)), 6) as score from vectors q join vectors d on q.id >= 10 and d.id < 10),
r as (select *, row_number() over (partition by id order by score desc, topic) as k from b), t as (select unnest([0.0, 0.1, 0.2, 0.3])::double as least) select topic, least, count(*) as n from r join t on score >= least where k = 1 group by 1, 2"""


def family_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Reports that a threshold links to their nearest description, and how many of these have the label that the rules give it."""
    v = V.vectors(spark, sf)
    families = v.where("id < 10")
    best = R.nearest(families.select(F.col("id").alias("doc"), "v"), v.where("id >= 10").select(F.col("id").alias("query"), "v"), 1)
    told = best.join(families.select(F.col("id").alias("doc"), F.col("label").alias("family")), "doc").join(v.select(F.col("id").alias("query"), "label"), "query")
    levels = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.2, 0.3)]))
    return told.select("score", (F.col("family") == F.col("label")).alias("agrees"), levels.alias("least")).groupBy("least").agg(F.count_if(F.col("score") >= F.col("least")).alias("linked"), F.count_if((F.col("score") >= F.col("least")) & F.col("agrees")).alias("agreed"))


AGREEMENT = V.with_(V.VECTORS) + """, b as (select q.id, q.label = d.label as agrees, d.id as topic, round(list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v)), 6) as score from vectors q join vectors d on q.id >= 10 and d.id < 10),
r as (select *, row_number() over (partition by id order by score desc, topic) as k from b), t as (select unnest([0.0, 0.1, 0.2, 0.3])::double as least)
select least, count(*) filter (where score >= least) as linked, count(*) filter (where score >= least and agrees) as agreed from r cross join t where k = 1 group by least"""


def topic_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of a topic: title terms that two reports of a group or more hold (all terms if there is none), by group."""
    from pressloom.functions.text import tokens

    n = V.news(spark, sf).select(F.pmod("id", F.lit(50)).alias("group"), "id", F.explode(F.array_distinct(tokens(F.col("title")))).alias("term"))
    counts = n.groupBy("group", "term").agg(F.count("*").alias("k"))
    most = counts.withColumn("most", F.max("k").over(Window.partitionBy("group")))
    return most.where("k >= 2 or most < 2").groupBy("group").agg(F.count("*").alias("terms"), F.min("term").alias("first"), F.max("k").alias("most"))


def _terms_sql() -> str:
    from pressloom.plans.intake import tokens_sql

    return V.with_(V.NEWS) + f""", t as (select id % 50 as g, unnest(list_distinct({tokens_sql('title')})) as term from news), c as (select g, term, count(*) as k from t group by 1, 2), m as (select *, max(k) over (partition by g) as most from c)
select g as "group", count(*) as terms, min(term) as first, max(k) as most from m where k >= 2 or most < 2 group by g"""


def linked_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Groups without a case take the case that names them. Nations are groups, suppliers the cases."""
    groups = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("group"), F.when(F.col("n_nationkey") % 4 == 0, F.col("n_nationkey").cast("long") * 1000).alias("case_id"))
    return X.linked_cases(groups, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_nationkey").cast("long").alias("group")))


LINKED = "select n_nationkey as \"group\", coalesce(case when n_nationkey % 4 = 0 then n_nationkey * 1000 end, (select min(s_suppkey) from supplier where s_nationkey = n_nationkey)) as case_id from nation"

QUERIES = {
    "rendered_claims": (rendered_claims, RENDERED),
    "family_agreement": (family_agreement, AGREEMENT),
    "current_decisions": (current_decisions, CURRENT), "draft_overlay": (draft_overlay, OVERLAY), "official_refresh": (official_refresh, REFRESH), "questions_of_cases": (questions_of_cases, QUESTIONS), "proven_packages": (proven_packages, PROVEN),
    "human_labels": (human_labels, LABELS), "answer_states": (answer_states, ANSWERS), "pair_evaluation": (pair_evaluation, PAIR_EVAL), "zero_shot": (zero_shot, ZERO_SHOT), "topic_terms": (topic_terms, _terms_sql()), "linked_cases": (linked_cases, LINKED),
}
