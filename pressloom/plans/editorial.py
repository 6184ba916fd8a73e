"""Review, citation and consistency queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.storage import table
from pressloom.functions.text import comparable, fold, word_pattern
from pressloom.operators import context as C
from pressloom.operators import reviews as R
from pressloom.operators import verify as X
from pressloom.plans import views as V
from pressloom.plans.intake import ACC

CASES = "cases as (select distinct user_id as case_id, (user_id % 4)::bigint as version from events union select c_custkey, 0 from customer where c_custkey between 1000 and 1020)"


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.pmod("user_id", F.lit(4)).alias("version")).distinct()
    return e.union(table(spark, sf, "customer").where("c_custkey between 1000 and 1020").select("c_custkey", F.lit(0).cast("long"))).distinct()


def review_states(spark: SparkSession, sf: str) -> DataFrame:
    """Current state of every case, those without decisions too."""
    return R.current_state(V.reviews(spark, sf), _cases(spark, sf).select("case_id").distinct())


STATES = V.with_(V.REVIEWS, CASES) + "select c.case_id, coalesce(arg_max(state, row(us, seq)), 'nuevo') as state from (select distinct case_id from cases) c left join reviews r on r.case_id = c.case_id group by c.case_id"


def review_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Moves that are not allowed, counted."""
    return R.transition_errors(V.reviews(spark, sf)).groupBy("previous", "state").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


_ALLOWED = " or ".join(f"(previous = '{a}' and state in ({', '.join(repr(b) for b in bs)}))" for a, bs in R.MOVES.items())
MOVES = V.with_(V.REVIEWS) + f"select previous, state, count(*) as n, min(seq) as first from (select *, lag(state) over (partition by case_id order by us, seq) as previous from reviews) where previous is not null and not ({_ALLOWED}) group by 1, 2"


def bound_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Latest decision on the version that a case has now."""
    return R.version_bound(V.reviews(spark, sf), _cases(spark, sf))


BOUND = V.with_(V.REVIEWS, CASES) + "select c.case_id, c.version, arg_max(state, row(us, seq)) as state from cases c left join reviews r on r.case_id = c.case_id and r.version = c.version group by 1, 2"


def review_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """The timeline of each case."""
    changes = _cases(spark, sf).select("case_id", (F.lit(V.START * 1_000_000) + F.col("version") * 86_400_000_000 * 7).alias("us"), "version")
    return R.timeline(V.reviews(spark, sf), changes).select("case_id", "us", "kind", "what", "supersedes", F.col("place").cast("long").alias("place"))


TIMELINE = V.with_(V.REVIEWS, CASES) + f""", a as (select case_id, us, 'decision' as kind, state as what, false as supersedes, seq from reviews union all
select c.case_id, {V.START * 1_000_000} + c.version * 604800000000, 'change', 'v' || c.version, coalesce((select min(version) from reviews r where r.case_id = c.case_id) < c.version, false), c.version from cases c)
select case_id, us, kind, what, supersedes, place from (select *, row_number() over (partition by case_id order by us desc, kind, seq) as place from a)"""


def case_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of orders with their lines, and which of their earlier hashes are stale."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("content"))
    ev = l.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("evidence_id"), F.concat_ws(":", F.col("l_partkey").cast("string"), "l_returnflag").alias("text"))
    now = R.snapshots(cases, ev)
    before = R.snapshots(cases, ev.where("evidence_id < 7"))
    return R.reconcile(before, now).groupBy("archived").agg(F.count("*").alias("n"), F.min("hash").alias("least"), F.max("hash").alias("most"))


SNAP = """with e as (select l_orderkey as k, l_linenumber as i, l_linenumber || '=' || l_partkey || ':' || l_returnflag as p from lineitem),
h as (select o_orderkey as k, sha256(o_orderstatus || '#' || coalesce(string_agg(p, '|' order by p), '')) as now, sha256(o_orderstatus || '#' || coalesce(string_agg(p, '|' order by p) filter (where i < 7), '')) as was
  from orders left join e on e.k = o_orderkey group by o_orderkey, o_orderstatus)
select was <> now as archived, count(*) as n, min(was) as least, max(was) as most from h group by 1"""


def _claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Benchmark texts as claims; each cites the document of its own number twice over; a third of the passages is altered."""
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    claims = b.select(F.col("item_id").alias("claim"), F.concat("text", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" 12,50 and "), F.col("item_id") * 1000)).otherwise(F.lit(""))).alias("text"))
    evidence = d.select(F.col("doc_id").alias("evidence"), F.create_map(F.lit("title"), F.split("text", "\n")[0], F.lit("text"), F.col("text"), F.lit("count"), F.concat(F.lit("12.5 "), F.col("n_chars"))).alias("fields"))
    cited = b.join(d.select("doc_id", "text").withColumnRenamed("text", "t"), F.col("item_id") == F.col("doc_id"))
    start = F.substring("t", 3, 30)
    passage = F.when(F.col("item_id") % 3 == 0, F.reverse(start)).when(F.col("item_id") % 3 == 1, F.upper(start)).otherwise(start)
    citations = cited.select(F.col("item_id").alias("claim"), F.when(F.col("item_id") % 10 == 9, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("evidence"), F.when(F.col("item_id") % 10 == 8, "summary").otherwise("text").alias("field"), passage.alias("passage"))
    return claims, citations, evidence


CLAIMS = """claims as (select item_id as claim, text || case when item_id % 2 = 0 then ' 12,50 and ' || (item_id * 1000) else '' end as text from benchmark),
cited as (select item_id as claim, case when item_id % 10 = 9 then -doc_id else doc_id end as evidence, case when item_id % 10 = 8 then 'summary' else 'text' end as field,
  case item_id % 3 when 0 then reverse(substr(d.text, 3, 30)) when 1 then upper(substr(d.text, 3, 30)) else substr(d.text, 3, 30) end as passage from benchmark join documents d on item_id = doc_id)"""


def citation_check(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each citation."""
    _, citations, evidence = _claims(spark, sf)
    return X.citation_errors(citations, evidence).select("claim", "evidence", "error")


CITATIONS = "with " + CLAIMS + """ select claim, evidence, case when d.doc_id is null then 'unknown evidence' when field <> 'text' then 'unknown field' when not contains(d.text, passage) then 'not literal' end as error from cited left join documents d on d.doc_id = evidence"""


def repaired_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Passages put right where they differ in case and accents alone, or a little."""
    _, citations, evidence = _claims(spark, sf)
    return X.repaired(citations, evidence).select("claim", "found")


def figure_support(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of claims that nothing they cite supports."""
    return X.unsupported_figures(*_claims(spark, sf)).select("claim", X.shown(F.col("figure")).alias("figure"))



def claim_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Claims kept or dropped, with the reasons."""
    claims, citations, evidence = _claims(spark, sf)
    broken = X.citation_errors(citations, evidence).where("error is not null").select("claim", F.concat(F.lit("citation: "), "error").alias("reason"))
    uncited = claims.join(citations, "claim", "left_anti").select("claim", F.lit("no citation").alias("reason"))
    figures = X.unsupported_figures(claims, citations, evidence).select("claim", F.concat(F.lit("figure: "), X.shown(F.col("figure"))).alias("reason"))
    return X.claim_report(claims, [broken, uncited, figures])


def references(spark: SparkSession, sf: str) -> DataFrame:
    """References that lead nowhere, by rule."""
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer", "embeddings", "documents", "labels", "supplier", "nation")}
    ids = lambda name, c: t[name].select(F.col(c).alias("id"))
    return X.missing_references({"line-order": (ids("lineitem", "l_orderkey"), ids("orders", "o_orderkey")), "order-customer": (ids("orders", "o_custkey"), ids("customer", "c_custkey")), "label-vector": (ids("labels", "doc_id"), ids("embeddings", "vec_id")), "document-vector": (ids("documents", "doc_id"), ids("embeddings", "vec_id")), "supplier-nation": (ids("supplier", "s_nationkey"), ids("nation", "n_nationkey"))})


REFERENCES = " union all ".join(f"select '{rule}' as rule, id from (select distinct {a} as id from {s}) where id not in (select {b} from {d})" for rule, s, a, d, b in (("line-order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("order-customer", "orders", "o_custkey", "customer", "c_custkey"), ("label-vector", "labels", "doc_id", "embeddings", "vec_id"), ("document-vector", "documents", "doc_id", "embeddings", "vec_id"), ("supplier-nation", "supplier", "s_nationkey", "nation", "n_nationkey")))


def vector_check(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with a wrong dimension, values or length; some are spoilt here."""
    v = V.vectors(spark, sf)
    spoilt = F.when(F.col("id") % 50 == 7, F.slice("v", 1, 63)).when(F.col("id") % 50 == 8, F.transform("v", lambda x: x * 0)).when(F.col("id") % 50 == 9, F.transform("v", lambda x: F.lit(float("nan")))).otherwise(F.col("v"))
    return X.vector_problems(v.select("id", spoilt.alias("v")), 64)


VECTOR_CHECK = "select vec_id as id, case vec_id % 50 when 7 then 'dimension' when 8 then 'zero' else 'not finite' end as problem from embeddings where vec_id % 50 in (7, 8, 9)"


def closest_event(spark: SparkSession, sf: str) -> DataFrame:
    """For each report, the catalog event nearest in time within a day whose magnitude is within 0.3 of its own."""
    reports = V.news(spark, sf).select("id", "moment", F.round(F.pmod("id", F.lit(60)) / 10, 1).alias("magnitude"))
    e = table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("event"), F.floor(F.expr(V.MICROS) / 1_000_000).alias("moment"), F.round("value", 1).alias("magnitude"))
    return C.closest_event(reports, e)


CLOSEST = V.with_(V.NEWS) + """, e as (select event_id as event, epoch_us(ts) // 1000000 as moment, round(value, 1) as magnitude from events where event_type = 'error'),
p as (select n.id, e.event, abs(n.moment - e.moment) as gap, row_number() over (partition by n.id order by abs(n.moment - e.moment), e.event) as r from news n join e on abs(n.moment - e.moment) <= 86400 and round(abs(round((n.id % 60) / 10, 1) - e.magnitude), 1) <= 0.3)
select id, event, gap from p where r = 1"""
RULES = [("prices", ("the and", "idiot"), ("en",)), ("trade", ("que", "moron"), ()), ("weather", ("nicht",), ("de",))]


def context_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that fire on a report, with the word that fired."""
    n = V.news(spark, sf).select("id", F.concat_ws("\n", "title", "body").alias("text"), F.col("lang").alias("topic"))
    return C.fired_rules(n, RULES)


def _rules_sql() -> str:
    parts = []
    for name, words, topics in RULES:
        where = f"lang in ({', '.join(repr(t) for t in topics)})" if topics else "true"
        parts.append(f"select id, '{name}' as rule, regexp_extract({ACC.format('(title || chr(10) || body)')}, '{word_pattern(words)}', 1) as word from news where {where}")
    return V.with_(V.NEWS) + "select * from (" + " union all ".join(parts) + ") where word <> ''"


def table_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules read from a table: a region's rule fires on the names of its nations, in even regions only for suppliers in debt."""
    nations, region = table(spark, sf, "nation"), table(spark, sf, "region")
    words = nations.groupBy(F.col("n_regionkey").alias("ord")).agg(F.array_sort(F.collect_list(fold(F.col("n_name")))).alias("words"))
    topics = F.when(F.col("ord") % 2 == 0, F.array(F.lit("debt")))
    rules = region.select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name")).join(words, "ord").select("ord", "name", "words", topics.alias("topics"), F.lit(None).cast("array<struct<kind:string,prefix:string>>").alias("finders"), F.lit(None).cast("string").alias("none"))
    s = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    told = s.select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", F.lit("Envíos desde"), "n_name", F.lit("por"), "s_name").alias("text"), F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit").alias("topic"))
    return C.fired_rules(told, C.read_rules(rules))


TABLE_RULES = "select s_suppkey as id, r_name as rule, lower(n_name) as word from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where r_regionkey % 2 <> 0 or s_acctbal < 0"


def question_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The precomputed answer (the first) to each question, found by its comparable form. First lines are the questions."""
    n = V.news(spark, sf).select("id", comparable(F.col("title")).alias("key"))
    return n.join(n.groupBy("key").agg(F.min("id").alias("answer")), "key").where("answer <> id").select("id", "answer")


ANSWERS = V.with_(V.NEWS) + f""", c as (select id, trim(regexp_replace(regexp_replace({ACC.format('title')}, '[¿?]', '', 'g'), '\\s+', ' ', 'g')) as k from news)
select id, answer from c join (select k, min(id) as answer from c group by k) using (k) where answer <> id"""

QUERIES = {
    "table_rules": (table_rules, TABLE_RULES),
    "review_states": (review_states, STATES), "review_moves": (review_moves, MOVES), "bound_decisions": (bound_decisions, BOUND), "review_timeline": (review_timeline, TIMELINE), "case_snapshots": (case_snapshots, SNAP),
    "citation_check": (citation_check, CITATIONS), "repaired_citations": (repaired_citations, None), "figure_support": (figure_support, None), "claim_verdicts": (claim_verdicts, None), "references": (references, REFERENCES),
    "vector_check": (vector_check, VECTOR_CHECK), "closest_event": (closest_event, CLOSEST), "context_rules": (context_rules, _rules_sql()), "question_answers": (question_answers, ANSWERS),
}
